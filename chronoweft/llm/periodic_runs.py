"""Runs of words that repeat with a period, by an online sparse diagonal programme.

A word that equals the one q words before it continues the diagonal of lag q; a diagonal of m matches that ends is a run of
m + q words. The plain programme follows, from each word, the lags to all its earlier occurrences, which is the square of a
frequent word's count. It is kept sparse by what a run must look like: a run of smallest period q and three periods or more has
m >= 2 q matches, so for g words with q <= g <= 2 q (and at least 16) the g words from any place of the diagonal lie in it, and
their nearest earlier occurrence is exactly q back: one nearer would give the run a smaller period. So of the earlier occurrences
of each place only the nearest of its g words is an active lag, for g = 16, 32, 64 and so on: one lag a level. Its match length grows as long as
the next word's lag is the same; where that ends, the run is emitted. Levels end when no g words stand twice, for most texts at the first.
The cost is n log(n) sorts of numbers whatever repeats, and equal numbers are equal words, not hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least matches of a diagonal that can be a run of 24 words or more and three periods.
FIRST = 16
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbers(words: list[bytes]) -> np.ndarray:
    """Words by the number of their first distinct occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _paired(names: np.ndarray, step: int) -> np.ndarray:
    """Names of 2 x ``step`` words from names of ``step`` words."""
    both = names[:-step] * (int(names.max()) + 1) + names[step:]
    return np.unique(both, return_inverse=True)[1]


def _may_repeat(ids: np.ndarray, length: int) -> bool:
    """Whether ``length`` (a power of two) words may stand twice: never false where they do."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < length:
        h = (h[:-step] * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[step:] + np.uint64(step))
        h ^= h >> np.uint64(32)
        step *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def find_runs(ids: np.ndarray, least: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``periods`` (3 or more) smallest periods and ``least`` (24 or more) words, by start, then period."""
    assert periods >= 3 and least >= 24
    n = len(ids)
    if n < least or not _may_repeat(ids, FIRST):
        return []
    names, g = ids, 1
    while g < FIRST:
        names, g = _paired(names, g), 2 * g
    out: list[np.ndarray] = []
    low = 0
    while True:
        order = np.argsort(names, kind="stable")
        again = names[order[1:]] == names[order[:-1]]
        if not again.any():
            break
        lag = np.zeros(len(names), np.int64)
        lag[order[1:][again]] = (order[1:] - order[:-1])[again]
        lag[(lag <= low) | (lag > g)] = 0
        edge = np.flatnonzero(np.diff(lag, prepend=0, append=0))
        first, last = edge[:-1], edge[1:]
        q = lag[first]
        length = last - first + g - 1 + q  # matches of the diagonal and the period before them
        take = (q > 0) & (length >= np.maximum(least, periods * q))
        out.append(np.stack([first[take] - q[take], length[take], q[take]], 1))
        if 2 * g >= n:
            break
        names, low, g = _paired(names, g), g, 2 * g
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return [tuple(r) for r in found[np.lexsort((found[:, 2], found[:, 0]))].tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the test rule makes periodic in a tenth of the documents; a null id keeps its words."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def report(words: list[bytes]) -> tuple:
    """The digest columns of one text's words."""
    runs = find_runs(numbers(words))
    kept = words
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, length, q in runs:
            drop[s + q] += 1
            drop[s + length] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop[:-1])) if not d]
    best: tuple | None = None
    for r in runs:  # in the order of ties
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    whole = hashlib.sha256(b" ".join(kept)).hexdigest()
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), listed, whole)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of every row of ``docs`` (doc_id, text; other columns are not looked at), ``RESULT``: number of runs, the run of the greatest
    length / period (ties: smallest start, then period), and digests of all runs and of the words that stay when every run keeps its first period only.

    Words are what the six white spaces of ASCII part, compared byte by byte. Null and empty texts have no word and no run, repeated rows are alike, texts of any
    length are taken whole in memory of some 100 bytes a word. ``plant``: periodic tails by the rule of ``planted``. An empty table gives no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or b"").split()  # exactly the six white spaces, as these are bytes
                rows.append((i, *report(planted(words, i) if plant else words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, RESULT)


def texts_without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, runs (start, length, period) of every row: the words that stay, joined by one space, and what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            ids, texts, found = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or b"").split()
                runs = find_runs(numbers(words))
                gone = {k for s, length, q in runs for k in range(s + q, s + length)}
                ids.append(i)
                texts.append(b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.list_(span))], names=["doc_id", "text", "runs"])

    kind = "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, kind)
