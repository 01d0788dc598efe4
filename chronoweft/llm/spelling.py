"""Spelling variants by Bloom-guided neighbourhoods.

1. Words are counted over all texts, by parts before the shuffle; frequent ones are the vocabulary.
2. Each length of words has its own blocked Bloom filter: a word sets a few bits of one 64-bit block. Spark merges the blocks and only
   the filters, of a bounded size, go to the driver and out with the tasks. More words make them denser, never larger.
3. A task makes all words at one deletion, and at one replacement by a later letter, of its words and asks the filters of the two lengths. A word's
   hash is the exclusive or of a number for each (place, letter), so that of an edit takes two more numbers and no string.
   An insertion is the deletion seen from the other word, an earlier letter the replacement seen from it.
4. Only positive edits become strings and are joined with the vocabulary, which removes the false ones. What is left are the links.
5. A word's form is its near word of the largest count, if that is large enough; counts grow along forms, so doubling the
   steps a fixed number of times reaches every root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise, release

#: Letters of a word: ASCII, of which only capitals are lowered, and the code points from U+00C0 to U+00FF.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Blocks of 64 bits of all filters at most (32 MB), words for each block below that, and bits that a word sets.
BLOCKS, WORDS_PER_BLOCK, BITS = 1 << 22, 2, 5
#: Edits looked at in one go.
PROBES = 1 << 20
#: Blocks that one row brings to the driver.
CHUNK = 1 << 14
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def found_words(docs: DataFrame, misspell: int | None) -> DataFrame:
    """word for every run of letters in the texts. With ``misspell``, a run loses the letter number h % length where that number divides the h of document and run."""
    run = F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), LETTERS[:26].upper(), LETTERS[:26]), F.lit("[a-zÀ-ÿ]+"), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("long").cast("string").alias("id"), run.alias("word"))
    if misspell is None:
        return runs.select("word")
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("word")))
    at = F.pmod(h, F.length("word")).cast("int")
    less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return runs.select(F.when(F.coalesce(h % misspell == 0, F.lit(False)), less).otherwise(F.col("word")).alias("word"))


def _number(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit number for each (place, letter)."""
    x = (place.astype(np.uint64) * np.uint64(128) + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(words: list[str], length: int) -> np.ndarray:
    """Letters by number: [words, length]."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), length)


def hashes(c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(c), np.uint64)
    for i in range(c.shape[1]):
        out ^= _number(np.uint64(i), c[:, i])
    return out


def _slot_and_mask(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of a word's length and its bits in it; the bits come from other bits of the hash than the block."""
    slot = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros_like(h)
    for k in range(BITS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return slot.astype(np.int64), mask


def filter_sizes(by_length: dict[int, int], blocks: int = BLOCKS) -> dict[int, tuple[int, int]]:
    """(first block, number of blocks) for each length, in proportion to its words; at most ``blocks`` and one for each length."""
    total = sum(by_length.values())
    scale = min(1 / WORDS_PER_BLOCK, blocks / max(1, total))
    out, at = {}, 0
    for length, n in sorted(by_length.items()):
        out[length] = (at, max(1, int(n * scale)))
        at += out[length][1]
    return out


def build_filters(vocabulary: DataFrame, sizes: dict[int, tuple[int, int]]) -> np.ndarray:
    """All blocks, one after the other. The bits of a block are merged by Spark, a row of the result brings ``CHUNK`` blocks."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, g in b.groupby(b["word"].str.len()):
                first, n = sizes[length]
                slot, mask = _slot_and_mask(hashes(codes(g["word"].tolist(), length)), n)
                yield pd.DataFrame({"slot": slot + first, "mask": mask.view(np.int64)})

    def chunk(g: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK, np.int64)
        bits[g["slot"].to_numpy() % CHUNK] = g["mask"].to_numpy()
        return pd.DataFrame({"chunk": [int(g["slot"].iloc[0]) // CHUNK], "bits": [bits.tobytes()]})

    merged = vocabulary.select("word").mapInPandas(place, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    rows = merged.groupBy(F.floor(F.col("slot") / CHUNK).alias("c")).applyInPandas(chunk, "chunk long, bits binary").collect()
    out = np.zeros((max((r["chunk"] for r in rows), default=0) + 1) * CHUNK, np.uint64)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], np.uint64)
    return out


def positive_edits(words: list[str], length: int, sizes: dict[int, tuple[int, int]], blocks: np.ndarray) -> Iterator[tuple[int, str]]:
    """(number of the word, edit) for deletions and replacements by a later letter of words of one length that the filters let pass."""

    def passes(h: np.ndarray, n: int) -> np.ndarray:
        first, size = sizes[n]
        slot, mask = _slot_and_mask(h, size)
        return (blocks[first + slot] & mask) == mask

    alphabet, shorter = np.arange(len(LETTERS)), length - 1 in sizes
    step = max(1, PROBES // len(LETTERS))
    for at in range(0, len(words), step):
        part = words[at : at + step]
        c = codes(part, length)
        whole = hashes(c)
        after = np.zeros(len(part), np.uint64)  # the letters behind a deleted one, a place further to the front
        for i in range(length - 1, -1, -1):
            own = _number(np.uint64(i), c[:, i])
            whole ^= own  # the letters before i
            if shorter:
                once = np.ones(len(part), bool) if i == 0 else c[:, i] != c[:, i - 1]  # of equal letters side by side the first
                hit = np.flatnonzero(once & passes(whole ^ after, length - 1))
                for k in hit:
                    yield at + int(k), part[k][:i] + part[k][i + 1 :]
            after = after ^ _number(np.uint64(max(i - 1, 0)), c[:, i])
        whole = hashes(c)
        for i in range(length):
            base = whole ^ _number(np.uint64(i), c[:, i])
            h = base[:, None] ^ _number(np.full(len(LETTERS), i), alphabet)[None, :]
            hit = passes(h.reshape(-1), length).reshape(h.shape) & (alphabet[None, :] > c[:, i][:, None])
            for k, x in zip(*np.nonzero(hit)):
                yield at + int(k), part[k][:i] + LETTERS[x] + part[k][i + 1 :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words (word, n) that differ by one letter put in, left out or replaced."""
    by_length = {r["length"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().collect()}
    sizes = filter_sizes(by_length)
    shared = vocabulary.sparkSession.sparkContext.broadcast((sizes, build_filters(vocabulary, sizes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, blocks = shared.value
        for b in batches:
            for length, g in b.groupby(b["word"].str.len()):
                words, n = g["word"].tolist(), g["n"].tolist()
                found = [(words[k], n[k], e) for k, e in positive_edits(words, length, sizes, blocks)]
                if found:
                    yield pd.DataFrame(found, columns=["word", "n", "near"])

    asked = materialise(vocabulary.select("word", "n").mapInPandas(run, "word string, n long, near string"), "positive-edits")
    links = materialise(asked.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"), "near-words")
    release(asked)
    return links.union(links.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame, rounds: int = 5) -> DataFrame:
    """word, root: the last form that forms (word, form) lead to. A form's count is at least five times its word's, so a chain of words
    has less than 28 steps below 2^63, and each round doubles the steps."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        before, next_ = found, found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = materialise(before.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        release(before)
    return found


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, misspell: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least ``least_letters`` letters that stands ``least_count`` times or more in the texts of
    ``docs`` (doc_id, text; other columns are not looked at).

    Words are runs of ASCII letters, lower-cased, and of the code points U+00C0 to U+00FF as they are. ``form``: the near word (one letter put in, left out or replaced)
    of the largest count, ties by the first in code-point order, if its count is at least ``ratio`` (5 or more) times the word's, else null; ``root``: the last of the
    forms from the word on, itself if none; ``n_near``: number of near words. Null and empty texts have no words, repeated rows count each, an empty table
    gives no rows. ``misspell``: letters left out by rule, as in ``found_words``; rows of a null id keep theirs. All words are compared, of any length.
    """
    assert ratio >= 5
    words = found_words(docs, misspell).where(F.length("word") >= least_letters)
    vocabulary = materialise(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count), "vocabulary")
    # of the near words the largest count is the least of its negative, ties by the word itself
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near"))
    near = materialise(near.select("word", "n_near", chosen.alias("form"), F.when(chosen.isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    out = vocabulary.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
