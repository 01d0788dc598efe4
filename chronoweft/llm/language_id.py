"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (words are the stretches between white space, longer than 32
characters: pieces of 32) and gives every byte position a distribution over the languages. A document
pools its positions: the language of the largest sum of log probabilities, with the mean probability of
that language over the positions as score. Trained in numpy by backpropagation through time.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import CACHE_ENTRIES, give_back, is_held_out, slices, texts, to_arrow_schema, with_carried, with_columns, worker_cache
from chronoweft.llm.gru import F32, Adam, gru_back, gru_states, gru_weights
from chronoweft.llm.words import WordTable, byte_matrix, segments

UNKNOWN = "und"
#: Training rows that a language gets at least, if it has them.
LEAST_ROWS = 50
#: Words are padded to the least of these widths, in bytes.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)


def _probabilities(w: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Log probabilities [time, words, languages] for bytes [words, time]."""
    f, b = ([], []) if keep is not None else (None, None)
    emb = w["emb"]
    # projected inputs of all 256 bytes first: a position is then one lookup
    hf = gru_states((emb @ w["f_w"] + w["f_b"])[x.T], w["f_u"], False, f)
    hb = gru_states((emb @ w["b_w"] + w["b_b"])[x.T], w["b_u"], True, b)
    h = np.concatenate([hf, hb], 2)
    logit = h @ w["out"] + w["bias"]
    logit -= logit.max(2, keepdims=True)
    if keep is not None:
        keep.update(f=f, b=b, h=h)
    return logit - np.log(np.exp(logit).sum(2, keepdims=True))


def train(samples: list[tuple[str, str]], hidden: int = 16, epochs: int = 4, batch: int = 512, rate: float = 0.01, seed: int = 7) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights and languages from (text, language) pairs. Each distinct (word, language) is one example,
    weighted by the root of its count and, so that languages weigh alike, by its language."""
    rng = np.random.default_rng(seed)
    counts = Counter((s, lang) for text, lang in samples for s in segments(text) if any(c.isalpha() for c in s))
    langs = sorted({lang for _, lang in counts})
    total = Counter()
    for (_, lang), n in counts.items():
        total[lang] += n**0.5
    groups: dict[int, list] = {}
    for (s, lang), n in counts.items():
        size = len(s.encode("utf-8", "replace"))
        groups.setdefault(next(x for x in WIDTHS if x >= size), []).append((s, langs.index(lang), n**0.5 / total[lang] * len(counts) / len(langs)))
    del counts, total
    w = {"emb": (0.5 * rng.standard_normal((256, 12))).astype(F32)}
    w |= gru_weights(rng, "f", 12, hidden) | gru_weights(rng, "b", 12, hidden)
    w |= {"out": np.zeros((2 * hidden, max(1, len(langs))), F32), "bias": np.zeros(max(1, len(langs)), F32)}
    adam = Adam(w, rate)
    packed = [(byte_matrix([s for s, _, _ in g], width), np.array([y for _, y, _ in g]), np.array([k for _, _, k in g], F32)) for width, g in sorted(groups.items())]
    del groups
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        orders = [(g, o[i : i + batch]) for g, o in enumerate(rng.permutation(len(p[0])) for p in packed) for i in range(0, len(o), batch)]
        for j in rng.permutation(len(orders)):
            g, rows = orders[j]
            x, y, k = packed[g][0][rows], packed[g][1][rows], packed[g][2][rows]
            keep: dict = {}
            p = np.exp(_probabilities(w, x, keep))
            mask = (x.T > 0) * k
            d = p
            d[:, np.arange(len(y)), y] -= 1
            d *= (mask / max(1.0, float((x > 0).sum())))[:, :, None].astype(F32)
            d_h = d @ w["out"].T
            n = w["f_u"].shape[0]
            d_f, u_f = gru_back(np.ascontiguousarray(d_h[:, :, :n]), w["f_u"], keep["f"])
            d_b, u_b = gru_back(np.ascontiguousarray(d_h[:, :, n:]), w["b_u"], keep["b"])
            grads = {"out": np.tensordot(keep["h"], d, ((0, 1), (0, 1))), "bias": d.sum((0, 1)), "f_u": u_f, "b_u": u_b, "f_b": d_f.sum((0, 1)), "b_b": d_b.sum((0, 1))}
            byte = x.T.ravel()
            one = np.zeros((256, byte.size), bool)
            one[byte, np.arange(byte.size)] = True
            at_f, at_b = one.astype(F32) @ d_f.reshape(byte.size, -1), one.astype(F32) @ d_b.reshape(byte.size, -1)
            grads |= {"f_w": w["emb"].T @ at_f, "b_w": w["emb"].T @ at_b, "emb": at_f @ w["f_w"].T + at_b @ w["b_w"].T}
            adam.step(grads)
    return w, langs


def word_scores(w: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    """Per word: sums over its positions of the languages' log probabilities, of their probabilities,
    and the number of positions; zeros for words without a letter."""
    langs = w["bias"].size
    out = np.zeros((len(words), 2 * langs + 1), F32)
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(words):
        if any(map(str.isalpha, s)):
            size = len(s) if s.isascii() else len(s.encode("utf-8", "replace"))
            groups.setdefault(next(x for x in WIDTHS if x >= size), []).append(i)
    for width, all_rows in groups.items():
        for at in range(0, len(all_rows), 4096):
            rows = all_rows[at : at + 4096]
            x = byte_matrix([words[i] for i in rows], width)
            mask = (x.T > 0)[:, :, None]
            p = _probabilities(w, x)
            out[rows] = np.concatenate([(p * mask).sum(0), (np.exp(p) * mask).sum(0), mask.sum(0)], 1)
    return out


def rows_each(counts: Sequence[int], total: int) -> int:
    """The largest number of rows a language such that all together are at most ``total``; ``LEAST_ROWS`` at least."""
    left = total
    for n, count in enumerate(sorted(counts)):
        if count * (len(counts) - n) > left:
            return max(LEAST_ROWS, left // (len(counts) - n))
        left -= count
    return max(LEAST_ROWS, *counts, 0)


def training_sample(docs: DataFrame, max_documents: int, max_chars: int) -> list[tuple[str, str]]:
    """Labelled rows outside the held-out fold, of each language those of the least hashes of the id: all, or
    as many as share ``max_documents`` out evenly, ``LEAST_ROWS`` at least; one row of an id. Rows of more than ``max_chars`` characters
    are not drawn; drawn texts are whole."""
    labelled = docs.where("lang is not null and text is not null").where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))).where(F.length("text") <= max_chars)
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = rows_each(list(counts.values()), max_documents)
    found = labelled.select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    # only hashes below a bound of the language are dealt out, about twice its rows, and one row of an id; where ids repeat, that may be too few
    full, widen = 2**63 - 1, 2
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    while True:
        bounds = {lang: full if n <= widen * each else int(-(2**63) + 2**64 * (widen * each / n)) for lang, n in counts.items()}
        near = found.join(F.broadcast(docs.sparkSession.createDataFrame([*bounds.items()], "lang string, bound long")), "lang").where("h <= bound")
        rows = near.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("n", nth).where(F.col("n") <= each).orderBy("h", "lang").collect()
        got = Counter(r["lang"] for r in rows)
        if all(got[lang] >= min(each, n) or bounds[lang] == full for lang, n in counts.items()):
            break
        widen *= 8
    return [(r["text"], r["lang"]) for r in rows]


def language_id(docs: DataFrame, max_documents: int = 1600, max_chars: int = 10_000, train_on: DataFrame | None = None, carry: Sequence[str] = (), **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_positions for every row of ``docs`` (doc_id, text, lang).

    Trains on a bounded sample of ``train_on`` (default: ``docs``) that holds rows of every labelled language: whole texts of
    up to ``max_chars`` characters, ``max_documents`` of them shared out evenly over the languages. Every whole text of any
    length is then scored, repeated rows alike. ``und`` with score 0 if the text is null or has no letter, and for
    all texts if no row is labelled. Ties go to the alphabetically first language. An empty table gives no rows. Needs no
    shuffle beyond the choice of the sample; of further columns of ``docs`` those in ``carry`` are returned as well.
    ``n_positions``: bytes of the words with letters.
    """
    spark = docs.sparkSession
    learn = (docs if train_on is None else train_on).select("doc_id", "text", "lang")
    weights, langs = train(training_sample(learn, max_documents, max_chars), **options)
    give_back()
    shared, key = spark.sparkContext.broadcast(weights), uuid.uuid4().hex

    schema = with_carried("doc_id long, held_out boolean, lang_pred string, score double, n_positions long", docs, carry)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        words, n = worker_cache(key, lambda: WordTable(lambda words: word_scores(w, words), CACHE_ENTRIES)), len(langs)
        for b in slices(batches, 1000):
            split = [segments(t) for t in texts(b.column("text"))]
            rows, vectors = words.find([s for x in split for s in x])
            ends = np.cumsum([len(x) for x in split])
            sums = np.zeros((len(split), 2 * w["bias"].size + 1))
            for i, (s, e) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                sums[i] = vectors[rows[s:e]].sum(0, dtype=np.float64)
            positions = sums[:, -1]
            best = sums[:, :n].argmax(1) if n else np.zeros(len(split), int)
            score = sums[np.arange(len(split)), w["bias"].size + best] / np.maximum(positions, 1)
            known = (positions > 0) & (n > 0)
            yield with_columns(b, kinds, {
                "lang_pred": [langs[i] if k else UNKNOWN for i, k in zip(best, known)],
                "score": np.where(known, np.clip(score, 0, 1), 0.0), "n_positions": positions.astype(np.int64),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    return rows.mapInArrow(run, schema)
