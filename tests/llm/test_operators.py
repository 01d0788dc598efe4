"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, lang="en"):
    parts = {"en": ["the", "and", "ing", "th", "er", "on"], "de": ["der", "sch", "ung", "ein", "ß"], "fr": ["eau", "que", "é", "le", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 120), lang := rng.choice(["en", "de", "fr"])), lang, "s", 1) for i in range(300)]
    base = words(rng, 200)
    rows += [(1000 + i, base if i < 3 else base + " tail" * i, "en", "s", 1) for i in range(8)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "  \n \t ", "en", "s", 5), (2003, "12 34 !!", "en", "s", 8), (2004, "x" * 20000, "en", "s", 20000), (2005, "a  b \n ①", "en", "s", 8)]
    rows += [rows[0]]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", piece string")


def test_packing_is_gapless_and_whole(docs):
    from tokenizers import Tokenizer

    from chronoweft.llm.packing import best_fit_packing

    rows, df = docs
    path = P.path("byte_bpe_50k.json")
    got = best_fit_packing(df, path, 256).toPandas()
    lib = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 256 + 1
        for k, s in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[s : first if k == 0 else s + 256]
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    g = got.sort_values(["sequence_id", "offset", "length"])
    assert (g["offset"] == g.groupby("sequence_id")["length"].cumsum() - g["length"]).all()
    assert g.groupby("sequence_id")["length"].sum().max() <= 256


def test_plan_pairs_large_items_and_fills_gaps():
    from chronoweft.llm.packing import plan_bins

    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        plan, bins = plan_bins(counts, 100)
        load = np.zeros(bins, int)
        large = np.zeros(bins, int)
        for r in plan.sort_values("offset").itertuples():
            for b in range(r.first_bin, r.first_bin + (r.hi - r.lo) // r.per_bin):
                assert load[b] == r.offset
                load[b] += r.length * r.per_bin
                large[b] += r.per_bin * (3 * r.length > 100)
        assert load.max() <= 100 and large.max() <= 2
        assert load.sum() == sum(n * c for n, c in counts.items())
        total = math.ceil(load.sum() / 100)
        assert bins <= max(1.3 * total + 2, sum(c for n, c in counts.items() if 2 * n > 100) + 2 + 0.6 * total)


def test_odd_texts_tokenise_like_the_library():
    from chronoweft.llm.packing import TextTokenizer

    w, rng = TextTokenizer(P.path("byte_bpe_50k.json")), random.Random(1)
    assert w.fast is not None and TextTokenizer(P.path("word_bpe_49k.json")).fast is None
    parts = ["a", "b", " ", " ", "\n", "é", "😀", "'s", "1", "<|endoftext|>", ".", "\t", " ", "\x00", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [f"x{c}y {c}{c} 1{c}2 {c} -{c}" for c in map(chr, range(0x110000)) if rng.random() < 0.02 and not c.encode("utf-8", "ignore") == b""]
    texts += ["x" * 30_000, "ab" * 20_000, " " * 5_000, " " * 2_000_000, "one" + "\n" * 2_000_000 + "two", "a" + " \t" * 25_000 + "b", "a" + " " * 49_999 + "b"]
    assert [w.encode(t) for t in texts] == [e.ids for e in w.lib.encode_batch(texts, add_special_tokens=False)]


def test_prefix_counts_equal_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    from chronoweft.llm.token_counts import PrefixCounter, token_counts

    path = P.path("piece_bpe_32k.model")
    sp, c = SentencePieceProcessor(model_file=path), PrefixCounter(path)
    for t in ["a  b \n ①x", "  ", " ", "▁▁", "x▁ y", "<s>hi</s><0x0A>", "naïve é", "", "thinger of 12,5"]:
        assert c.prefix_counts(t) == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert c.prefix_counts(t)[c.cut_for(t, 2)] <= 2
    rows, df = docs
    got = token_counts(df, path, 10).toPandas()
    assert sorted(zip(got["doc_id"], got["n_bytes"], got["n_tokens"], got["over_limit"])) == sorted((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 10) for r in rows)


def test_unigram_against_all_segmentations_and_round_trip(docs):
    from chronoweft.llm.unigram import decode, encode, model

    path = P.path("piece_bpe_32k.model")
    m = model(path)
    score = {p: m.score[i] for i, p in m.pieces.text.items()}
    assert math.isclose(sum(math.exp(x) for x in score.values()), 1) and max(score.values()) < 0

    def best(unit):
        if not unit:
            return 0.0
        out = best(unit[1:]) + m.fallback if unit[0] not in m.pieces.score else -1e18
        return max([out, *(score[unit[:n]] + best(unit[n:]) for n in range(1, len(unit) + 1) if unit[:n] in m.pieces.score)])

    for unit in ["▁the", "▁thinger", "▁①b", "▁▁x", "▁ab,c"]:
        ids, bytes_ = m.viterbi(unit), set(m.pieces.byte_id.values())
        single = sum(c not in m.pieces.score for c in unit)
        assert math.isclose(sum(m.score[i] for i in ids if i not in bytes_) + single * m.fallback, best(unit))
    assert all(dict(m.trie.prefixes(p, 0))[len(p)] == i for p, i in list(m.pieces.id.items())[::37])
    rows, df = docs
    back = {r["doc_id"]: r["text"] for r in decode(encode(df, path), path).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in rows)


def test_unigram_ids_equal_the_library(docs):
    """The library reads the same pieces, log scores and byte pieces from a model written by hand."""
    import struct

    from sentencepiece import SentencePieceProcessor

    from chronoweft.llm.unigram import model

    m = model(P.path("piece_bpe_32k.model"))

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda field, raw: number(field << 3 | 2) + number(len(raw)) + raw
    flag = lambda field, n: number(field << 3) + number(n)
    kinds = {0: ("<unk>", 2), 1: ("<s>", 3), 2: ("</s>", 3)} | {i: (f"<0x{b:02X}>", 6) for b, i in m.pieces.byte_id.items()}
    raw = b""
    for i in range(len(m.pieces.text) + len(kinds)):
        piece, kind = kinds.get(i) or (m.pieces.text[i], 1)
        raw += part(1, part(1, piece.encode()) + number(2 << 3 | 5) + struct.pack("<f", m.score.get(i, 0.0)) + flag(3, kind))
    raw += part(2, flag(3, 1) + flag(35, 1)) + part(3, part(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))
    sp = SentencePieceProcessor(model_proto=raw)
    rng = random.Random(6)
    texts = [r[1] for r in docs[0] if r[1] and len(r[1]) < 5000]
    texts += ["".join(rng.choice("abc dé①😀,.\n1  ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    apart = 0
    for t in texts:
        ids = m.encode(t)
        if ids != sp.encode(t):  # a tie, which 32-bit sums may settle otherwise
            apart += 1
            bytes_ = set(m.pieces.byte_id.values())
            value = lambda x: sum(m.score[i] for i in x if i not in bytes_)
            assert math.isclose(value(ids), value(sp.encode(t)), rel_tol=1e-5)
        assert m.decode(ids) == t
    assert apart < 0.02 * len(texts)


def test_ngram_join_equals_brute_force(docs):
    from chronoweft.llm.ngram_join import WORD, choose_bands, ngram_jaccard_join

    bands, rows_ = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9995
    rows, df = docs

    def grams(t):
        w = WORD.findall((t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r[0], grams(r[1])) for r in rows]
    got = {(r["doc_id"]): r for r in ngram_jaccard_join(df).collect()}
    linked = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    for n, (i, s) in enumerate(sets):
        assert got[i]["n_links"] == sum(bool(linked(s, t)) for m, (_, t) in enumerate(sets) if m != n), i
    assert {got[i]["component_id"] for i in range(1000, 1008)} == {1000}
    assert got[2000]["kept"] and got[2000]["n_links"] == 0


def test_large_cluster_is_cut_into_blocks(spark, monkeypatch):
    from chronoweft.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(8)
    base = words(rng, 300).split()
    df = spark.createDataFrame([(i, " ".join([*base[:150], f"w{i}", *base[150:]])) for i in range(15)], "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(df).collect()
    assert all(r["n_links"] == 14 and r["component_id"] == 0 for r in got)


def test_chained_cluster_is_verified_by_bucket(spark, monkeypatch):
    """Texts that each share most words with the next only: one cluster, links between near ones alone."""
    from chronoweft.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(9)
    text = words(rng, 400).split()
    rows = [(i, " ".join(f"{w}{k}" for k, w in list(enumerate(text))[12 * i : 12 * i + 100])) for i in range(25)]
    rows += [(100 + i, rows[3][1] + f" end{i}") for i in range(6)]
    grams = [(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))) for i, t in rows for w in [ngram_join.WORD.findall(t.lower())]]
    for by_bucket in (True, False):
        if not by_bucket:  # the other plan gives the same links
            monkeypatch.setattr(ngram_join, "BLOCK", 10_000)
        got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.7, recall=0.99999).collect()}
        assert got == {i: sum(10 * len(s & t) >= 7 * len(s | t) for j, t in grams if j != i) for i, s in grams}


def test_repeated_ids_with_other_texts_keep_their_links(spark):
    from chronoweft.llm.ngram_join import ngram_jaccard_join

    a, b = "one two three four five six seven eight", "red green blue black white grey pink brown"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b), (4, b), (None, a), (5, None)]
    got = sorted((tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links", "component_id", "kept").collect()), key=str)
    want = [(1, 1, 2, 1, True), (1, 1, 3, 1, True), (2, 1, 2, 1, False), (3, 1, 3, 1, False), (4, 1, 3, 1, False), (4, 1, 3, 1, False), (None, 1, 2, 1, False), (5, 5, 0, 5, True)]
    assert got == sorted(want, key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def vector_rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 16))
    x[60:90] = x[5] + 0.15 * rng.standard_normal((30, 16))
    x[90:95] = x[5]
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 7 == 0)) for i, v in enumerate(x)]
    return rows + [(500, None, 0), (501, [0.0] * 16, 0), (502, [None] + [1.0] * 15, 0), (503, [float("nan")] * 16, 0), (504, rows[5][1], None)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    from chronoweft.llm import vector_dedup

    rows = vector_rows()
    good = [(i, np.array(v, float), y) for i, v, y in rows if i < 500]
    links = {i: {j for j, w, z in good if j != i and z == y and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93} for i, v, y in good}
    for tile, least in ((2048, 4096), (16, 50)):
        monkeypatch.setattr(vector_dedup, "LEAST_FOR_AXES", least)
        got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(vectors(spark, rows), tile=tile).collect()}
        assert len(got) == len(rows)
        for i, _, _ in rows:
            seen, todo = {i}, [i]
            while todo:
                new = links.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            assert (got[i]["n_links"], got[i]["component_id"]) == (len(links.get(i, ())), min(seen)), i


def test_vectors_equal_on_the_first_axis_are_cut_into_tiles(spark, monkeypatch):
    from chronoweft.llm import vector_dedup

    rng, seen, real = np.random.default_rng(8), [], vector_dedup.materialise
    rows = [(i, [0.0, *map(float, v)], 1) for i, v in enumerate(rng.integers(0, 2, (900, 11)))]
    monkeypatch.setattr(vector_dedup, "materialise", lambda df, name: (seen.append((name, out := real(df, name))), out)[1])
    monkeypatch.setattr(vector_dedup, "release", lambda *t: None)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(vectors(spark, rows), tile=64).collect()}
    sizes = [r["count"] for name, t in seen if name == "tiles" for r in t.groupBy("tile").count().collect()]
    assert max(sizes) <= 3 * 64
    x = np.array([v for _, v, _ in rows])
    length = np.sqrt((x * x).sum(1))
    linked = (x @ x.T >= 0.93 * np.outer(length, length) - 1e-12) & (length > 0) & (length > 0)[:, None]
    assert got == {i: int(linked[i].sum() - linked[i, i]) for i in range(900)}


def test_near_duplicates_of_several_lengths(spark):
    from chronoweft.llm.vector_dedup import near_duplicates

    rows = [(0, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [0.0, 0.0, 1.0], 1), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.1], 1), (5, [1.0, 2.0], 2), (None, [0.0, 0.0, 2.0], 1), (6, [], 1), (7, [5.0], 1), (None, [3.0], 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    want = [(0, 0, 0, True), (1, 0, 1, True), (2, 1, 2, True), (None, 1, 2, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    from chronoweft.llm.mtree import top_k

    rows = vector_rows()
    x = {i: np.floor(64 * np.array(v, float)) for i, v, _ in rows if v and None not in v and not any(map(math.isnan, v))}
    got = top_k(vectors(spark, rows), tree_size=40).collect()
    assert sorted(map(tuple, top_k(vectors(spark, rows)).collect())) == sorted(map(tuple, got))
    want = {(q, n + 1, i, int(s)) for q in x if q % 20 == 0 for n, (s, i) in enumerate(sorted(((-(x[q] @ x[i]), i) for i in x if i != q))[:20]) for s in [-s]}
    assert {tuple(r) for r in got} == want
    assert top_k(vectors(spark, []).limit(0)).count() == 0


def test_top_k_of_copies_lengths_and_repeated_ids(spark):
    from chronoweft.llm.mtree import top_k

    rows = [(i, [1.0, 0.0], 0) for i in range(60)] + [(0, [1.0, 0.0], 0)] * 3 + [(41, [0.5, 0.0], 0)] * 2 + [(100, [1.0, 1.0, 1.0], 0), (101, [2.0, 0.0, 0.0], 0), (7, [0.0, 0.0, -1.0], 0), (None, [1.0, 0.0], 0), (120, [], 0), (121, [], 0)]
    df = vectors(spark, rows)
    for size in (8192, 1):
        got: dict = {}
        for r in sorted(top_k(df.withColumn("score", df["label"]), k=5, tree_size=size).collect()):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got[0] == [(i, 4096) for i in range(1, 6)]
        assert got[20] == [(0, 4096)] * 4 + [(1, 4096)]  # rows that repeat an id are candidates each
        assert got[100] == [(101, 8192), (7, -4096)] and got[120] == [(121, 0)] and set(got) == {0, 20, 40, 100, 120}


def test_tree_avoids_comparisons_on_clustered_vectors():
    from chronoweft.llm.mtree import Tree, build_pages

    import pandas as pd

    rng = np.random.default_rng(4)
    x = np.floor(64 * (np.repeat(rng.standard_normal((40, 16)), 100, 0) + 0.05 * rng.standard_normal((4000, 16))))
    tree = Tree(pd.DataFrame(build_pages([[i] for i in range(4000)], [[1]] * 4000, x, rng)), 16)
    for q in range(0, 4000, 100):
        got = sorted((-s, -i) for s, i in tree.search(x[q], q, 20))
        assert got == sorted((-int(x[q] @ x[i]), i) for i in range(4000) if i != q)[:20]
    assert tree.compared < 0.25 * 40 * 4000


def test_licences_and_inheritance(spark):
    from chronoweft.llm.license_scan import license_scan

    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", None), (2, "a/b/c/x.py", "nothing here", None), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", None),
        (4, "a/b/y.py", "Licensed under CC BY-NC 4.0.\ncode", None), (5, "z/q.py", "no licence", None), (6, "a/t.py", None, None), (7, None, "x", None),
    ]
    got = {r["id"]: (r["license"], r["origin"], r["license_path"]) for r in license_scan(spark.createDataFrame(rows, "id long, path string, text string, is_license boolean")).collect()}
    assert got[2] == ("Apache-2.0", "inherited", "a/b/LICENSE") and got[4][:2] == ("CC-BY-NC-4.0", "own") and got[6] == ("MIT", "inherited", "a/LICENSE")
    assert got[5] == got[7] == (None, "none", None) and got[1][1] == "own"


def test_licence_beside_common_words_and_in_a_long_paragraph(spark):
    from chronoweft.llm.license_scan import license_scan

    line = "See the project details here: licensed under the Apache License, Version 2.0, in this project, see details"
    long = "\n".join([*(f"filler {i} of a paragraph that never ends" for i in range(150)), "Redistribution and", "use in source and", "binary forms, with or without", "modification, are permitted", "provided that the", "following conditions are met", *(f"more {i} of it" for i in range(150))])
    rows = [(0, "a/0", line, False), (1, "b/1", long, False), (2, "c/2", "Distributed under the Boost Software License, Version 1.0", False)]
    rows += [(10 + i, f"d/{i}", f"see the project details here in this {i}", False) for i in range(3000)]
    got = {r["id"]: (r["license"], r["origin"]) for r in license_scan(spark.createDataFrame(rows, "id long, path string, text string, is_license boolean")).where("id < 10").collect()}
    assert got == {0: ("Apache-2.0", "own"), 1: ("BSD-3-Clause", "own"), 2: ("BSL-1.0", "own")}


def test_long_paragraphs_and_unclosed_tags_take_no_square_of_time():
    import time

    from chronoweft.llm.license_scan import VOCABULARY, Index
    from chronoweft.llm.template_extraction import Parser

    index, rng = Index({}, 1000, 0.6), random.Random(1)
    text = "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(8)) for _ in range(20_000))
    start = time.time()
    lines, segments = index.segments(text, True)
    found = index.scan(lines, segments, {})
    assert len(text) > 900_000 and found[0] > 0.6 and time.time() - start < 90
    for html in ("<a " * 330_000, "<div>" * 200_000, "<article>" * 110_000, '<a b="' * 160_001 + ">", "<!x" * 330_000, "<li><ul>" + "<span>" * 80_000 + "<li></li>" * 50_000):
        start = time.time()
        Parser().parse(html).levels()
        assert time.time() - start < 30


def test_licences_equal_brute_force(spark):
    """Every window of lines of a paragraph, every paragraph, and whole licence files, against the templates."""
    from collections import Counter

    from chronoweft.llm.license_scan import TEMPLATES, license_scan
    from chronoweft.llm.license_scan import words as tokens

    rng = random.Random(12)
    notices = [t for texts in TEMPLATES.values() for t in texts] + ["You may copy and distribute this program under the terms of the GNU General Public, version 3 of the Free Software Foundation"]
    common = ["the", "of", "and", "to", "in", "this", "software", "license", "version"]
    rows = []
    for i in range(250):
        lines = [" ".join(rng.choice(common) if rng.random() < 0.3 else words(rng, 1) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]
        if i % 2:
            w = rng.choice(notices).split()
            w = [x for x in w if rng.random() > 0.1 * (i % 3)]
            k = rng.randint(2, 12)
            at = rng.randint(0, len(lines))
            lines[at:at] = [" ".join(w[j : j + k]) for j in range(0, len(w), k)]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), "  ")
        rows.append((i, f"d{i}/x", "\n".join(lines), i % 7 == 0))
    repeated = " ".join([notices[0]] * 3) + " of other words there are more than one notice could bear " + " ".join(words(rng, 1) for _ in range(9))
    rows += [(899, "e/0", f"{words(rng, 40)}\n{repeated}\n{words(rng, 40)}", False), (900, "e/1", notices[-1], False), (901, "e/2", None, None), (902, None, "", None), (903, "f/LICENSE", "filler\n" * 6000 + "Released under the MIT License", None), (5, "d5/x", rows[5][2], False)]
    n = len(rows)
    df = Counter(w for r in rows for w in set(tokens(r[2] or "")))
    vector = lambda t: {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(tokens(t)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    known = [(name, v, length(v)) for name, texts in TEMPLATES.items() for t in texts for v in [vector(t)]]

    def best(text, whole):
        lines, parts = text.split("\n"), {text} if whole else set()
        for i in range(len(lines)):
            for j in range(i, min(len(lines), i + 40)):
                if not lines[j].strip():
                    break
                parts.add("\n".join(lines[i : j + 1]))
        out = (0.0, "")
        for v in map(vector, parts):
            size = length(v)
            out = max([out, *((sum(x * v.get(w, 0.0) for w, x in t.items()) / size / m, name) for name, t, m in known)])
        return out

    frame = spark.createDataFrame([(*r, "clash") for r in rows], "id long, path string, text string, is_license boolean, score string")
    got = license_scan(frame).collect()
    assert len(got) == n
    by = {r["id"]: r for r in got}
    hits = 0
    for i, path, text, whole in rows:
        score, name = best(text or "", whole or (path or "").endswith("LICENSE"))
        r = by[i]
        if score >= 0.6:
            hits += 1
            assert abs(r["score"] - score) < 1e-9 and (r["license"], r["origin"]) == (name, "own"), (i, name, r)
        else:
            assert r["origin"] != "own"
    assert hits > 80 and license_scan(frame.limit(0)).count() == 0


def test_main_text_of_pages(spark):
    from chronoweft.llm.template_extraction import extract_main_text

    page = '<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>{}<footer>F</footer></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(f"<article><h1>Head {i}</h1><p>Body &amp; more\n  {i}<p>Two<aside>no</aside></article><div id='comments'><p>bad</p></div>")) for i in range(8)]
    rows += [(20 + i, f"http://g.example/{i}", page.format(f"<div><p>Share this</p><p>Story number {i} &lt;3</p></div>")) for i in range(8)]
    rows += [(50, None, None), (51, "http://h.example/e", ""), (52, "odd", "<p>plain")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("Head 3 Body & more 3 Two", 24)
    assert got[22][0] == "Story number 2 <3"
    assert got[50] == got[51] == ("", 0) and got[52][0] == "plain"


def test_template_decides_where_no_name_helps(spark):
    """Pages of plain div elements: menu and footer stand on every page, the article is where the pages' own text is."""
    from chronoweft.llm.template_extraction import extract_main_text, page_text

    page = "<html><body><div><div><p>Home</p><p>News</p></div><div><p>Hot: {0}x</p></div><div><h1>Head {0}</h1>{1}</div><div><p>About us</p></div></div></body></html>"
    own = lambda i: "".join(f"<p>Story {i} goes on for a while with words {k}</p>" for k in range(i % 4 + 1))
    rows = [(i, f"http://h.example/{i}", page.format(i, own(i)).replace("<div><div>", "<div class='w'><div class='a'>").replace("</div><div><h1>", "</div><div class='b'><h1>").replace("</div><div><p>Hot", "</div><div class='c'><p>Hot")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    changed = 0
    for i, _, html in rows:
        assert got[i] == " ".join([f"Head {i}", *(f"Story {i} goes on for a while with words {k}" for k in range(i % 4 + 1))])
        changed += got[i] != page_text(html)
    assert changed == 12  # the page alone gives its menus too


def test_classes_equal_brute_force(spark):
    from collections import Counter

    from chronoweft.llm.template_extraction import Parser, Template, classes, occurrences
    from pyspark.sql import functions as F

    rng = random.Random(13)
    part = lambda: rng.choice(["<p>own {}</p>", "<ul><li>a</li><li>b</li></ul>", "<p>same</p>", "<b>{}</b>"]).format(rng.random())
    pages = [(i, "h", "<html><body><div>Top</div>" + "".join(part() for _ in range(rng.randint(0, 5))) + "<i>end</i></body></html>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_key long, host string, html string")
    sizes = df.groupBy("host").agg(F.count("*").alias("pages"))
    found = [r for r in classes(occurrences(df.repartition(5)), sizes, 5, 0.6).collect() if r["class"] is not None]
    parsed = {i: Parser().parse(h) for i, _, h in pages}
    counts = {i: Counter(t for t, x in zip(p.tokens, p.texts) if not x or not x.isspace()) for i, p in parsed.items()}
    vectors: dict = {}
    for t in {t for c in counts.values() for t in c}:
        vectors.setdefault(tuple(counts[i][t] for i in range(20)), set()).add(t)
    want = {frozenset(ts) for v, ts in vectors.items() if sum(map(bool, v)) >= 12 and (len(ts) > 1 or max(v) == 1)}
    assert {frozenset(r["tokens"]) for r in found} == want
    # tokens out of order and cycles that cross break a class
    p = Parser().parse("<html><p>x</p><b>y</b><p>x</p></html>")
    ids = dict(zip((pl.name + repr(x) + str(n) for n, (pl, x) in enumerate(zip(p.places, p.texts))), p.tokens))
    html, para, x, bold = (next(v for k, v in ids.items() if k.startswith(q)) for q in ("html''", "p''", "p'x'", "b''"))
    assert Template([{"class": 1, "tokens": [para, x]}]).broken(p) == set()
    assert Template([{"class": 1, "tokens": [x, para]}]).broken(p) == {1}
    assert 2 in Template([{"class": 1, "tokens": [html, bold]}, {"class": 2, "tokens": [para, bold]}]).broken(p)


def test_pages_of_odd_kinds(spark):
    from chronoweft.llm.template_extraction import extract_main_text

    long = "<article>" + "<p>word &amp; more</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "c"), (1, None, None, "c"), (2, "", "", "c"), (3, "u", "<p>un<b>closed", "c"), (4, "http://a/1", long, "c"), (None, "http://a/1", "</div></p>text<", "c"), (5, "http://a/2", "<!-- only", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r["page_id"], r["text"]) for r in extract_main_text(df).collect()), key=str)
    want = [(1, ""), (1, ""), (2, ""), (3, "unclosed"), (4, " ".join(["word & more"] * 20_000)), (None, "text<"), (5, "")]
    assert got == sorted(want, key=str) and extract_main_text(df.limit(0)).count() == 0


def test_odd_texts_in_scorers_and_counters(spark):
    """Null ids and texts, empty and very long texts, repeated rows, columns of clashing names, empty tables."""
    from sentencepiece import SentencePieceProcessor

    from chronoweft.llm.packing import best_fit_packing
    from chronoweft.llm.token_counts import prefix_counts, token_counts
    from chronoweft.llm.toxicity import toxicity
    from chronoweft.llm.unigram import encode_report

    long = "some words that go on " * 30_000
    rows = [(1, None), (2, ""), (3, "  \n "), (4, long), (5, "a b"), (5, "a b"), (None, "no id"), (6, "x" * 100_000)]
    names = ["score", "held_out", "piece", "n_tokens", "ids_crc32", "predicted", "sequence_id"]
    df = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    path, none = P.path("piece_bpe_32k.model"), spark.createDataFrame([], "doc_id long, toxic int")
    sp = SentencePieceProcessor(model_file=path)
    counted = sorted(((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in token_counts(df, path).collect()), key=str)
    assert counted == sorted(((i, len(sp.encode(t or "")), len((t or "").encode())) for i, t in rows), key=str)
    assert {len(r["counts"]) for r in prefix_counts(df.where("doc_id = 5"), path).collect()} == {4}
    assert all(r["round_trip"] for r in encode_report(df, path).collect())
    scored = toxicity(df, none).collect()
    assert len(scored) == len(rows) and len({r["score"] for r in scored}) == 1  # nothing to learn from: all alike
    packed = best_fit_packing(df, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["doc_id"] == 5 for r in packed) == 2 and {r["length"] for r in packed if r["doc_id"] in (1, 2)} == {1}
    for empty in (token_counts(df.limit(0), path), encode_report(df.limit(0), path), toxicity(df.limit(0), none), best_fit_packing(df.limit(0), P.path("byte_bpe_50k.json"))):
        assert empty.count() == 0


def test_pipeline_runs_to_the_end(spark, tmp_path):
    """Toxic documents, documents without letters and copies go, all others are packed whole."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    rng = random.Random(14)
    rows, labels = [], []
    for i in range(240):
        w, bad = words(rng, rng.randint(20, 60), lang := rng.choice(["en", "de"])).split(), i % 4 == 0
        for _ in range(4 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum"]))
        rows.append((i, " ".join(w), lang, "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(300, rows[1][1], "en", "s", 1), (301, "123 !!", None, "s", 1), (302, None, None, None, None), rows[2]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = c.run(spark, f"file://{tmp_path}").collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    kept = {}
    for r in got:
        kept[r["doc_id"]] = kept.get(r["doc_id"], 0) + r["length"]
    assert not set(kept) & {300, 301, 302} and all(kept[i] == size[i] for i in kept)
    clean = {i for i in range(240) if i % 4}
    assert len(clean - set(kept)) <= 0.05 * len(clean) and len(set(kept) - clean) <= 0.05 * 60


def test_notice_repeated_inside_an_article(spark):
    from chronoweft.llm.template_extraction import extract_main_text

    page = "<html><body><article><h1>Head {0}</h1><p>Own <b>words</b> <i>{0}</i></p><p class='x7'>Follow us on all channels</p><div class='q'>Best of the week</div></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)]
    rows += [(20 + i, f"http://copies.example/{i}", page.format("same")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 Own words 3"
    assert got[22] == "Head same Own words same Follow us on all channels Best of the week"


def test_side_words_of_wrappers_and_parts_of_words():
    from chronoweft.llm.template_extraction import page_text

    for html in (
        "<body class='single has-sidebar'><article><p>Text</p></article></body>",
        "<body class='cookie-consent-open sidebar'><div><p>Text</p></div></body>",
        "<body><main class='content sidebar'><p>Text</p></main></body>",
        "<body><form id='aspnetForm'><div class='widget'>W</div><main><p>Text</p></main></form></body>",
        "<body><div class='sidebar'><article class='related'><p>Text</p></article></div></body>",
        "<body><article><div class='related-work'><p>Text</p></div></article></body>",
        "<body><article><p>Text</p><div class='share-buttons'>S</div></article><div class='site-footer'>F</div><div id='comments'><article><p>bad</p></article></div></body>",
    ):
        assert page_text(html) == "Text", html


def test_own_words_overrule_a_doubtful_side_word(spark):
    from chronoweft.llm.template_extraction import extract_main_text

    page = "<html><body><article><p>Head {0}</p><div class='notice'><p>Own {0}</p></div><div class='social'>Follow us</div><div class='comments'>Nice {0}</div></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 Own 3"


def test_language_on_held_out(docs):
    from chronoweft.llm.language_id import language_id

    rows, df = docs
    truth = {r[0]: r[2] for r in rows}
    got = language_id(df, epochs=6).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 2000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2000, 2001, 2002, 2003)} == {"und"}


def test_rare_language_is_in_the_training_sample(spark):
    from collections import Counter

    from chronoweft.llm.language_id import LEAST_ROWS, rows_each, training_sample

    df = spark.range(20000).selectExpr("id as doc_id", "concat('word ', id) as text", "if(id % 400 = 7, 'rare', if(id % 2 = 0, 'en', 'de')) as lang")
    got = Counter(lang for _, lang in training_sample(df, 60, 100))
    assert got == {"en": LEAST_ROWS, "de": LEAST_ROWS, "rare": df.where("lang = 'rare' and crc32(string(doc_id)) % 4 != 2").count()}
    assert rows_each([10, 1000, 5000], 2500) == 1490 and rows_each([10, 20], 2500) == LEAST_ROWS and rows_each([3000], 2500) == 2500


def test_language_without_labels_and_ties(spark):
    import corpus_pipeline as c
    from chronoweft.llm.language_id import language_id

    rows = [(i, t, None, "s", 1) for i, t in enumerate(["some words", None, "", "12 34", "word " * 50_000])] + [(None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id(df).collect()}
    assert set(got.values()) == {("und", 0.0)} and len(got) == len(rows)
    assert {r["doc_id"] for r in c.keep_known_languages(spark, df, "").collect()} == {0, 4, None}
    assert language_id(df.limit(0)).count() == 0
    # one text in two languages: equal probabilities go to the first
    both = spark.createDataFrame([(i, "aa bb cc", "xy"[i % 2], "clash") for i in range(200)], "doc_id long, text string, lang string, score string")
    assert {r["lang_pred"] for r in language_id(both, epochs=0).collect()} == {"x"}


def test_toxicity_on_held_out(spark):
    from chronoweft.llm.toxicity import toxicity

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        w, bad = words(rng, rng.randint(20, 80)).split(), i % 3 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, "")]
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)


def test_pipeline_stage_columns(spark, docs):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "best_fit_packing"]
    rows, df = docs
    kept = c.drop_near_duplicates(spark, df, "")
    assert kept.columns == c.COLUMNS
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1000 in ids and not set(ids) & set(range(1001, 1008))
    # rows of no group stay, and a repeated row once
    assert sorted(ids) == sorted({r[0] for r in rows} - set(range(1001, 1008)))


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline as c

    a, b = "one two three four five six seven eight", "red green blue black white grey pink brown"
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, "alone with words of its own here"), (None, "alone with words of its own here"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in c.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, "alone with words of its own here"), (4, None), (4, None), (5, "")], key=str)
    assert c.drop_near_duplicates(spark, df.limit(0), "").count() == 0
