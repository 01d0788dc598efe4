"""Best-fit packing of tokenised documents into fixed-size sequences.

Method: large-item matching. Items above one third of the capacity fit at most twice into a bin, so
they are matched greedily (largest item with the largest partner that fits); smaller items then go,
largest first, into the tightest gap. Lengths are integers up to the capacity, so the plan needs only
the histogram of lengths: at most ``capacity`` counts, whatever the number of documents. The plan maps
intervals of an item's rank among the items of its length to bins; Spark ranks the items.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: the split of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The rule above goes back over a run of white space, so its stack grows with the run: texts with longer ones go to ``tokenizers``.
SPACES = 50_000
_LONG_SPACE = re.compile(rf"\s{{{SPACES}}}")


def _byte_of_character() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary: printable bytes for themselves, the
    others, in order, from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TextTokenizer:
    """Ids of whole texts as ``tokenizers`` gives them, at a constant amount of memory.

    A byte-level BPE whose merges stand in the order of the ids of what they make is a table of ranks, which
    ``tiktoken`` encodes several times as fast and without a cache of words. Texts with an added token or more than
    ``SPACES`` white space characters in a row, and files of another kind, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranked(spec) if self._is_ranked(spec) else None

    @staticmethod
    def _is_ranked(spec: dict) -> bool:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("BPE", "ByteLevel", False, True):
            return False
        if spec["normalizer"] or spec["truncation"] or spec["padding"] or model.get("dropout") or model.get("ignore_merges"):
            return False
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = set(model["vocab"]) - {t["content"] for t in spec["added_tokens"]}
        return made == sorted(made) and len(made) + 256 == len(plain)

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        byte, added = _byte_of_character(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        return tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added) or len(text) > SPACES and _LONG_SPACE.search(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenizer(path: str) -> TextTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(("tokenizer", path), lambda: TextTokenizer(path))


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first of several is shorter than the capacity."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document (null text: empty, so the end id alone): ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, kinds = tokenizer(tokenizer_path), pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            # one text at a time: what a task holds besides the batch is the ids of one document
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*tok.encode(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(out, (i, k, s, n, zlib.crc32(ids[s : s + n]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Bins for ``counts`` items of each length, by large-item matching and best fit.

    Returns the intervals (length, lo, hi, per_bin, first_bin, offset: items of that length ranked from
    lo to hi - 1 stand per_bin to a bin, bins numbered from first_bin, side by side from offset) and the
    number of bins. Groups of equal bins are handled at once, so the work depends on the number of
    distinct lengths only.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    assert all(0 < n <= capacity for n in left)
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: groups of bins (first bin, number)
    bins = 0

    def place(n: int, bins_from: int, number: int, per: int, offset: int) -> None:
        rows.append((n, rank[n], rank[n] + number * per, per, bins_from, offset))
        rank[n] += number * per

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] >= 1 + (m == n)), None)
            k = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            place(n, bins, k, 2 if mate == n else 1, 0)
            if mate is not None and mate != n:
                place(mate, bins, k, 1, n)
                left[mate] -= k
            left[n] -= 2 * k if mate == n else k
            gaps[capacity - n - (mate or 0)].append((bins, k))
            bins += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g, groups in gaps.items() if g >= n and groups), default=None)
            if gap is None:  # new bins, filled one after the other
                gap, number = capacity, -(-left[n] // (capacity // n))
                gaps[gap].append((bins, number))
                bins += number
            first, number = gaps[gap].pop()
            per = min(gap // n, left[n])
            k = min(number, left[n] // per)
            place(n, first, k, per, capacity - gap)
            left[n] -= k * per
            gaps[gap - per * n].append((first, k))
            if number > k:
                gaps[gap].append((first + k, number - k))
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "per_bin", "first_bin", "offset"]).sort_values(["length", "lo"], ignore_index=True), bins


def pack_pieces(pieces: DataFrame, capacity: int = 1024, buckets: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length, further columns kept) with ``sequence_id`` and ``offset``.

    An item's rank among those of its length comes from counts by (length, bucket of its row) and a rank
    inside that bucket, so a length or an id that most items share is spread over all tasks. Only the histogram
    (at most ``capacity`` rows) reaches the driver, and only the intervals derived from it (a few
    thousand, bounded by the capacity) go out with the tasks. Equal (doc_id, piece) rows are packed
    each; an empty table gives an empty table.
    """
    spark = pieces.sparkSession
    items = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # fixed once written
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = plan_bins(counts, capacity)
    if buckets is None:
        buckets = max(16, sum(counts.values()) // 20_000)
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        big = 1 << 44  # ranks stay below it, so (length, rank) is one number
        i = np.searchsorted(p["length"].to_numpy() * big + p["lo"].to_numpy(), length.to_numpy() * big + rank.to_numpy(), side="right") - 1
        q = p.iloc[i]
        k = rank.to_numpy() - q["lo"].to_numpy()
        per = q["per_bin"].to_numpy()
        return pd.DataFrame({"sequence_id": q["first_bin"].to_numpy() + k // per, "offset": q["offset"].to_numpy() + k % per * length.to_numpy()})

    kept = pieces.columns
    return ranked.withColumn("w", where("length", "rank")).select(*kept, "w.sequence_id", "w.offset")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty texts are one piece that holds the end id alone; texts of any length are packed whole, in pieces. Repeated rows are packed
    each; pieces of one length are alike, and their order in the input settles which goes where. Further columns are not looked at,
    whatever their names. An empty table gives no rows.
    """
    return pack_pieces(tokenised_pieces(docs, tokenizer_path, capacity, end_id), capacity)
