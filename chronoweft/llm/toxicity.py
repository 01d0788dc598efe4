"""Toxicity by a bidirectional gated recurrent network with attention pooling, over overlapping windows.

A word enters as the sum of a hashed word embedding and the scaled sum of hashed embeddings of its character
3-, 4- and 5-grams. The network reads windows of 16 words, each starting 8 after the last, so every
word stands in two windows; attention weighs a window's positions, and a document's score is that of its
highest window. Trained in numpy: first on drawn windows with their document's label, then on the
highest windows of each document, as one bad passage makes a document toxic.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import CACHE_ENTRIES, give_back, is_held_out, slices, texts, to_arrow_schema, with_carried, with_columns, worker_cache
from chronoweft.llm.gru import F32, Adam, gru_back, gru_states, gru_weights, sigmoid
from chronoweft.llm.words import WordTable, byte_matrix, segments

WINDOW, STRIDE = 16, 8
WORDS, GRAMS, WIDE, HIDDEN = 1 << 15, 1 << 16, 10, 8


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, n-gram buckets of all words one after the other, their number in each word).

    Letters are taken in lower case and punctuation at either end is left off; bytes stand for characters.
    Every word has a gram at least: nothing but the two ends is one.
    """
    clean = [w.lower().strip(".,;:!?\"'()[]{}*#%&$|") for w in words]
    size = max([4, *(len(w.encode("utf-8", "replace")) for w in clean)])
    x = byte_matrix(clean, size).astype(np.uint64)
    x = np.concatenate([np.full((len(x), 1), 256, np.uint64), x, np.zeros((len(x), 2), np.uint64)], 1)
    length = np.maximum((x > 0).sum(1), 2)
    x[np.arange(len(x)), length] = 257
    mix, word = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(x), np.uint64)
    for i in range(x.shape[1]):
        word = np.where(i <= length, (word ^ x[:, i]) * mix, word)
    owner, grams = [], []
    for n in (3, 4, 5):
        h = np.zeros((len(x), x.shape[1] - n + 1), np.uint64)
        for k in range(n):
            h = (h ^ (x[:, k : k + h.shape[1]] + np.uint64(n))) * mix
        at = np.nonzero(np.arange(h.shape[1])[None, :] + n <= length[:, None] + 1)
        owner.append(at[0])
        grams.append((h[at] >> np.uint64(48)).astype(np.int32))
    owners = np.concatenate(owner)
    by_word = np.argsort(owners, kind="stable")
    return (word >> np.uint64(49)).astype(np.int32), np.concatenate(grams)[by_word], np.bincount(owners, minlength=len(x))


def _sums(w: dict[str, np.ndarray], word: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word vectors from their features."""
    if not len(word):
        return np.zeros((0, WIDE), F32)
    total = np.add.reduceat(w["gram"][grams], np.cumsum(counts) - counts)
    return w["word"][word] + total / np.sqrt(counts)[:, None].astype(F32)


def _vectors(w: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    parts = [_sums(w, *word_features(words[i : i + 4096])) for i in range(0, len(words), 4096)]
    return np.concatenate([np.zeros((0, WIDE), F32), *parts])


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word within it) of every window; a document without words has one empty window."""
    n = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def _logits(w: dict[str, np.ndarray], xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window from projected inputs [time, windows, 3 * hidden] and mask [time, windows]."""
    f, b = ([], []) if keep is not None else (None, None)
    h = np.concatenate([gru_states(xf, w["f_u"], False, f), gru_states(xb, w["b_u"], True, b)], 2)
    a = np.where(mask, h @ w["att"], -1e9)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    if keep is not None:
        keep.update(f=f, b=b, h=h, a=a, pooled=pooled)
    return pooled @ w["out"] + w["bias"][0]


def train(samples: list[tuple[str, int]], drawn: int = 10, batch: int = 256, rate: float = 0.01, decay: float = 0.004, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights from (text, label) pairs; without both labels, weights that score everything alike."""
    rng = np.random.default_rng(seed)
    w = {"word": np.zeros((WORDS, WIDE), F32), "gram": (0.1 * rng.standard_normal((GRAMS, WIDE))).astype(F32)}
    w |= gru_weights(rng, "f", WIDE, HIDDEN) | gru_weights(rng, "b", WIDE, HIDDEN)
    w |= {"att": np.zeros(2 * HIDDEN, F32), "out": np.zeros(2 * HIDDEN, F32), "bias": np.full(1, -2, F32)}
    if len({y for _, y in samples}) < 2:
        return w
    vocabulary: dict[str, int] = {"": 0}
    tokens_of = [np.array([vocabulary.setdefault(s, len(vocabulary)) for s in segments(t)], np.int32) for t, _ in samples]
    known = list(vocabulary)
    parts = [word_features(known[i : i + 4096]) for i in range(0, len(known), 4096)]
    word, grams, counts = (np.concatenate(p) for p in zip(*parts))
    del vocabulary, known, parts
    places = np.cumsum(counts) - counts
    flat = np.concatenate([*tokens_of, np.zeros(WINDOW, np.int32)])
    lengths = np.array([len(x) for x in tokens_of])
    start = np.cumsum(lengths) - lengths
    doc, first = windows(lengths)
    y = np.array([v for _, v in samples], F32)

    def tokens(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = first[rows][None, :] + np.arange(WINDOW)[:, None]
        mask = at < lengths[doc[rows]][None, :]
        return np.where(mask, flat[np.minimum(start[doc[rows]][None, :] + at, len(flat) - 1)], 0), mask

    def features(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of some words, their n-grams one after the other, and the numbers of these."""
        n = counts[used]
        g = grams[np.repeat(places[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return _sums(w, word[used], g, n) * (used > 0)[:, None], g, n

    def scores(rows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(rows), 4096):  # the words of some windows at a time: no table of all words is held
            ids, mask = tokens(rows[i : i + 4096])
            used, back = np.unique(ids, return_inverse=True)
            vec, back = features(used)[0], back.reshape(ids.shape)
            out.append(_logits(w, (vec @ w["f_w"] + w["f_b"])[back], (vec @ w["b_w"] + w["b_b"])[back], mask))
        return np.concatenate(out)

    adam = Adam(w, rate)

    def learn(rows: np.ndarray, target: np.ndarray) -> None:
        ids, mask = tokens(rows)
        used, back = np.unique(ids, return_inverse=True)
        back = back.reshape(ids.shape)
        vec, g, n = features(used)
        keep: dict = {}
        p = sigmoid(_logits(w, (vec @ w["f_w"] + w["f_b"])[back], (vec @ w["b_w"] + w["b_b"])[back], mask, keep))
        d = ((p - target) / len(rows)).astype(F32)
        h, a = keep["h"], keep["a"]
        d_pooled = d[:, None] * w["out"]
        d_a = (h * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_h = a[:, :, None] * d_pooled + d_e[:, :, None] * w["att"]
        d_f, u_f = gru_back(np.ascontiguousarray(d_h[:, :, :HIDDEN]), w["f_u"], keep["f"])
        d_b, u_b = gru_back(np.ascontiguousarray(d_h[:, :, HIDDEN:]), w["b_u"], keep["b"])
        at = back.ravel()
        fold = lambda x, i, n: np.stack([np.bincount(i, c, n) for c in x.T], 1).astype(F32)
        v_f, v_b = fold(d_f.reshape(at.size, -1), at, len(used)), fold(d_b.reshape(at.size, -1), at, len(used))
        d_v = (v_f @ w["f_w"].T + v_b @ w["b_w"].T) * (used > 0)[:, None]
        adam.step({
            "out": keep["pooled"].T @ d, "bias": d.sum(keepdims=True), "att": (d_e[:, :, None] * h).sum((0, 1)), "f_u": u_f, "b_u": u_b,
            "f_w": vec.T @ v_f, "b_w": vec.T @ v_b, "f_b": v_f.sum(0), "b_b": v_b.sum(0),
            "word": fold(d_v, word[used], WORDS), "gram": fold(np.repeat(d_v / np.sqrt(n)[:, None], n, 0), g, GRAMS),
        })
        for k in ("word", "gram"):  # embeddings of rare words fade unless examples keep bearing them out
            w[k] *= F32(1 - decay)

    def passes(rows: int, steps: int) -> int:
        """Passes over so many rows for at least that many steps: small samples are read again."""
        return min(40, max(1, -(-steps * batch // max(1, rows))))

    pick = np.argsort(rng.random(len(doc)) + doc, kind="stable")  # windows of each document in drawn order
    turn = np.arange(len(doc)) - np.repeat(np.searchsorted(doc, np.arange(len(lengths))), np.bincount(doc, minlength=len(lengths)))
    chosen = pick[turn < drawn]
    for _ in range(passes(len(chosen), 150)):
        order = rng.permutation(chosen)
        for i in range(0, len(order), batch):
            learn(order[i : i + batch], y[doc[order[i : i + batch]]])
    for _ in range(3):  # the highest window of each document, and one drawn window of the clean ones
        adam.rate = 0.5 * adam.rate
        logit = scores(np.arange(len(doc)))
        top = np.lexsort((-logit, doc))[np.searchsorted(doc, np.arange(len(lengths)))]
        more = rng.permutation(np.flatnonzero(y[doc] == 0))[: len(lengths)]
        for _ in range(passes(2 * len(top) + len(more), 30)):
            order = rng.permutation(np.concatenate([top, top, more]))
            for i in range(0, len(order), batch):
                learn(order[i : i + batch], y[doc[order[i : i + batch]]])
    return w


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``max_toxic`` and ``max_clean`` documents of the two labels outside the held-out fold (least hashes of the id), of
    at most ``max_chars`` characters."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("toxic in (0, 1)").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [rows.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id")).limit(n) for v, n in ((0, max_clean), (1, max_toxic))]
    ids = some[0].union(some[1])  # at most max_toxic + max_clean rows
    short = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    found = short.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_toxic: int = 2500, max_clean: int = 4500, max_chars: int = 10_000, train_on: DataFrame | None = None, carry: Sequence[str] = (), **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), n_windows for every row.

    Learns from a bounded sample of the labelled rows of ``train_on`` (default: ``docs``): at most
    ``max_toxic`` and ``max_clean`` of the two labels, each at most ``max_chars`` long. Every window of every whole text is
    scored, texts of any length whole; null and empty texts are one empty window. Rows are scored one by one, so repeated rows and
    ties are alike, and an empty table gives no rows; a null id is held out as null and never learned from; without labels of both kinds every score is that of the starting weights. Needs no
    shuffle of the texts. ``carry``: columns of ``docs`` to return as well.
    """
    spark = docs.sparkSession
    weights = train(training_sample(docs if train_on is None else train_on, labels, max_toxic, max_clean, max_chars), **options)
    give_back()
    shared, key = spark.sparkContext.broadcast(weights), uuid.uuid4().hex

    schema = with_carried("doc_id long, held_out boolean, score double, predicted int, n_windows long", docs, carry)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        both, blank = np.concatenate([w["f_w"], w["b_w"]], 1), np.concatenate([w["f_b"], w["b_b"]])
        words = worker_cache(key, lambda: WordTable(lambda words: _vectors(w, words), CACHE_ENTRIES // 2))
        for b in slices(batches, 400):
            split = [segments(t) for t in texts(b.column("text"))]
            lengths = np.array([len(x) for x in split])
            rows, vectors = words.find([s for x in split for s in x])
            # the words of this part by their own numbers, each projected once; the last stands for none
            used, rows = np.unique(rows, return_inverse=True)
            x_of = np.concatenate([vectors[used] @ both + blank, blank[None, :]])
            start, (doc, first) = np.cumsum(lengths) - lengths, windows(lengths)
            top = np.full(len(split), -np.inf)
            for i in range(0, len(doc), 2048):
                d = doc[i : i + 2048]
                place = first[i : i + 2048][None, :] + np.arange(WINDOW)[:, None]
                mask = place < lengths[d][None, :]
                at = np.full(mask.shape, len(used))
                at[mask] = rows[(start[d][None, :] + place)[mask]]
                x = x_of[at]
                np.maximum.at(top, d, _logits(w, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask))
            score = sigmoid(top)
            yield with_columns(b, kinds, {"score": score, "predicted": (score >= threshold).astype(np.int32), "n_windows": np.bincount(doc, minlength=len(split))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    return rows.mapInArrow(run, schema)
