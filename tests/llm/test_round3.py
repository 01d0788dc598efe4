"""Periodic runs, spelling variants and source mixing against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id long, text string, source string, size string, word string"


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(all(w[k] == w[k - p] for k in range(i - q + p, j)) for p in range(1, q)):
                out.append((i - q, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n, kinds):
    w = [rng.choice(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 3:
            a = rng.randrange(n)
            p, length = rng.randint(1, max(1, (n - a) // 3)), rng.randint(1, n - a)
            for i in range(a, a + length):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_brute_force():
    from chronoweft.llm.periodic_runs import find_runs, numbers

    rng, seen = random.Random(4), 0
    for _ in range(700):
        w = repetitive(rng, rng.randint(0, 240), [b"a", b"b", b"c", b"d", b"e"][: rng.randint(1, 5)])
        want = brute_runs(w)
        assert find_runs(numbers(w)) == want
        seen += len(want)
    assert seen > 300


def test_runs_of_long_repeats_are_quick():
    import time

    from chronoweft.llm.periodic_runs import find_runs, numbers

    start = time.time()
    assert find_runs(numbers([b"a"] * 600_000)) == [(0, 600_000, 1)]
    blocks = find_runs(numbers(([b"a"] * 500 + [b"b"]) * 1000))
    assert len(blocks) == 1001 and (0, 501_000, 501) in blocks
    assert time.time() - start < 30


def test_periodic_runs_of_documents(spark):
    from chronoweft.llm.periodic_runs import periodic_runs, texts_without_repeats

    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(repetitive(rng, rng.randint(1, 200), ["a", "b ", "ß", "D"])), "s", "x", "y") for i in range(120)]
    rows += [(500, None, None, None, None), (501, "", "s", "x", "y"), (502, " \n\t ", "s", "x", "y"), (None, "a " * 60, "s", "x", "y"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in periodic_runs(df, plant=True).collect()]
    want = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{a},{q}\n" for s, a, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 20
    assert periodic_runs(df.where("false")).count() == 0
    texts = {r["doc_id"]: r for r in texts_without_repeats(df).collect()}
    assert texts[500]["text"] == "" and texts[None]["text"] == "a" and [tuple(r) for r in texts[None]["runs"]] == [(0, 60, 1)]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, misspell=199):
    n = Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = (best if best and n[best] >= 5 * n[w] else None), len(others)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    stems = ["receive", "separate", "ÀÉßxyzz", "bookkeeper", "aaaaaa", "naïveté", "straße", "x" * 300]
    words = []
    for s in stems:
        words += [s] * 700
        for _ in range(4):
            v = s
            for c in (90, 12, 5):  # a chain of variants, rarer at each step
                i = rng.randrange(len(v))
                v = rng.choice([v[:i] + v[i + 1 :], v[:i] + rng.choice("abcéÿ") + v[i:], v[:i] + rng.choice("xyzüÖ") + v[i + 1 :]])
                words += [v.upper() if v.isascii() else v] * c
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "1"]).join(words[at : at + 40])) for i, at in enumerate(range(0, len(words), 40))]
    return rows + [(90000, None), (90001, ""), (90002, "12 ŁŁŁŁŁŁ"), (None, "receive receives"), rows[0]]


def test_spelling_variants_equal_brute_force(spark, texts):
    from chronoweft.llm.spelling import spelling_variants

    df = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in texts], DOCS)
    got = sorted((tuple(r) for r in spelling_variants(df, misspell=199).collect()), key=str)
    want = brute_variants(texts)
    assert got == sorted(want, key=str)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert spelling_variants(df.where("false")).count() == 0


def test_dense_filters_lose_nothing(spark, texts, monkeypatch):
    from chronoweft.llm import spelling

    real = spelling.filter_sizes
    monkeypatch.setattr(spelling, "filter_sizes", lambda n: real(n, 4))
    df = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in texts], DOCS)
    assert sorted((tuple(r) for r in spelling.spelling_variants(df, misspell=7).collect()), key=str) == sorted(brute_variants(texts, 7), key=str)


def test_apportionment_equals_highest_quotients(spark):
    from pyspark.sql import functions as F

    from chronoweft.llm.mixing import sainte_lague

    rng, rows = random.Random(2), []
    for g in [None, *range(12)]:
        seats = rng.choice([0, 1, 3, 50, 700])
        votes = [float(rng.choice([1, 1, 2, 5, 40, 1000])) for _ in range(rng.randint(1, 30))]
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
    got = {(r["g"], r["k"]): r["quota"] for r in sainte_lague(spark.createDataFrame(rows, "g int, k int, votes double, seats long"), F.col("g"), "k").collect()}
    groups = defaultdict(list)
    for g, k, v, seats in rows:
        groups[g].append((k, v, seats))
    for g, parties in groups.items():
        seats = parties[0][2]
        won = Counter(k for _, k in sorted((-v / (2 * s + 1), k) for k, v, _ in parties for s in range(seats))[:seats])
        assert {k: got[g, k] for k, _, _ in parties} == {k: won[k] for k, _, _ in parties}


def test_mix_meets_targets(spark):
    from chronoweft.llm.mixing import mix_sources

    rng = random.Random(12)
    sources = ["a", "B", "é", "b", None, "z", "tiny", "empty"]
    rows = [(i, "word x \n " * rng.randint(0, 400), s, "1", "w") for i in range(600) if (s := rng.choice(["a"] * 5 + sources[:6]))] + [(i, " ".join("ab" * 3), "tiny", "1", "w") for i in range(700, 706)]
    rows += [(900, None, "empty", "1", "w"), (901, "", "empty", "1", "w"), (None, "one two", "a", "1", "w"), *[(7, "same text here", "z", "1", "w")] * 200]
    df = spark.createDataFrame(rows, DOCS)
    got = mix_sources(df, shard_words=3000).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s, *_ in rows:
        size[s] += len((t or "").replace(" ", "x").split())
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]:
        for s in over:
            target[s] = 3 * size[s]
        free -= set(over)
        left = sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    by_size = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_size[r["source_size"], round(r["target"], 6)][0] += r["taken"]
    for s in names:
        assert (size[s], round(target[s], 6)) in by_size
    for (words, t), (taken, _) in by_size.items():
        same = sum(size[s] == words and abs(target[s] - t) < 1e-5 for s in names)
        assert abs(taken - same * t) <= max(2, 0.01 * t)
    again = mix_sources(df.repartition(7), shard_words=3000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mix_sources(df.where("false")).count() == 0
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mix_sources(df.where("source = 'empty'")).collect())


def test_block_of_queries_goes_through_a_tree_together():
    """Ties by id, copies, points of several ids and the query's own id, against all products; queries of no length, where all scores tie; cuts while results wait."""
    import numpy as np
    import pandas as pd

    from chronoweft.llm import mtree

    rng = np.random.default_rng(5)
    x = np.unique(np.vstack([np.zeros((1, 6)), rng.integers(-3, 4, (900, 6))]), axis=0).astype(float)
    ids = [[3 * i, 3 * i + 1] if i % 5 == 0 else [3 * i] for i in range(len(x))]
    copies = [[1 + (i % 7 == 0)] * len(n) for i, n in enumerate(ids)]
    pages = pd.DataFrame(mtree.build_pages(ids, copies, x, rng))
    rows = rng.permutation(len(x))[:200]
    rows[0] = int(np.flatnonzero((x == 0).all(1))[0])
    own = np.array([ids[i][-1] for i in rows])
    for held in (mtree.HELD, 50):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(mtree, "HELD", held)
            row, got, scores = mtree.Tree(pages, 6).search_all(x[rows], own, 20, np.full(len(rows), -np.inf))
        for n, i in enumerate(rows):
            every = [(-int(x[j] @ x[i]), e) for j in range(len(x)) for e, c in zip(ids[j], copies[j]) if e != own[n] for _ in range(c)]
            assert sorted(zip((-scores[row == n]).tolist(), got[row == n].tolist())) == sorted(every)[:20]
