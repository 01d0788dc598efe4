"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The trie holds the pieces' characters in two integer arrays: a state's child for character code c is
``base[state] + c`` if ``check`` there names the state. Viterbi keeps, for each end position, the best
sum of the pieces' log scores; a character without a piece of its own falls back to its UTF-8 bytes at a score
below that of any piece. Decoding joins pieces and bytes and turns markers into spaces.

A unigram model file has log scores of its own. One that was made by merging pairs has the merges' ranks in their place; as
tokenizers are not trained here, a rank r is then read as a log probability by Zipf's law: p is in proportion to 1 / (r + 1).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import CACHE_ENTRIES
from chronoweft.llm.pieces import MARK, Pieces, units

#: Score of one fallback character, below the least score of a piece by this much.
FALLBACK_PENALTY = 10.0
_models: dict[str, Unigram] = {}


class DoubleArray:
    """A double-array trie over strings, each with a value of 0 or more."""

    def __init__(self, entries: dict[str, int]):
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for s in entries for c in s}))}
        size = 4 * len(entries) + 4 * len(self.code) + 8192
        base, check, value = [0] * size, [-1] * size, [-1] * size
        free = np.ones(size, bool)
        free[0], check[0] = False, 0
        lowest = 1

        def fit(codes: list[int]) -> int:
            """The least base, from the first free slot on, at which all children are free."""
            nonlocal free, lowest
            lowest += int(free[lowest:].argmax())
            at, offsets = lowest, np.array(codes) - codes[0]
            while True:
                if at + 4096 + codes[-1] >= len(free):
                    grow = len(free)
                    free = np.pad(free, (0, grow), constant_values=True)
                    for column, fill in ((base, 0), (check, -1), (value, -1)):
                        column.extend([fill] * grow)
                slots = at + np.flatnonzero(free[at : at + 4096])
                good = slots[(slots > codes[0]) & free[slots[:, None] + offsets].all(1)]
                if len(good):
                    return int(good[0]) - codes[0]
                at += 4096

        todo = [(0, sorted(([self.code[c] for c in s], v) for s, v in entries.items()), 0)]
        while todo:
            state, group, depth = todo.pop()
            if len(group[0][0]) == depth:
                value[state] = group[0][1]
                group = group[1:]
            if not group:
                continue
            kids: dict[int, list] = {}
            for item in group:
                kids.setdefault(item[0][depth], []).append(item)
            codes = list(kids)
            base[state] = b = fit(codes)
            for c in codes:
                check[b + c] = state
                free[b + c] = False
            todo += [(b + c, kids[c], depth + 1) for c in codes]
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every entry that starts at ``at``."""
        state, code, base, check, value = 0, self.code, self.base, self.check, self.value
        for end in range(at, len(text)):
            c = code.get(text[end])
            if c is None:
                return
            child = base[state] + c
            if child >= len(check) or check[child] != state or child == 0:
                return
            state = child
            if value[state] >= 0:
                yield end + 1, value[state]


def log_scores(score: dict[str, float]) -> dict[str, float]:
    """Log scores of pieces: the given ones, or, where they are ranks (whole numbers from 0 down to no more than there are
    pieces, and one number below them all for pieces that no merge makes), logarithms of probabilities by rank."""
    ranks = sorted({-x for x in score.values()})
    whole = [r for r in ranks if r == int(r) and 0 <= r < len(score)]
    if len(whole) < 2 or len(whole) < len(ranks) - 1:
        return dict(score)
    place = {p: min(-x, whole[-1] + 1) - whole[0] + 1 for p, x in score.items()}
    total = sum(1 / r for r in place.values())
    return {p: -float(np.log(r * total)) for p, r in place.items()}


class Unigram:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.trie = DoubleArray(self.pieces.id)
        scores = log_scores(self.pieces.score)
        self.score = {i: scores[p] for i, p in self.pieces.text.items()}
        self.scores = [self.score.get(i, 0.0) for i in range(max(self.score) + 1)]  # by id
        self.fallback = min(self.score.values()) - FALLBACK_PENALTY
        self.bytes_of = {i: p.replace(MARK, " ").encode() for i, p in self.pieces.text.items()} | {i: bytes([b]) for b, i in self.pieces.byte_id.items()}
        self.byte_ids = set(self.pieces.byte_id.values())
        self.known: dict[str, tuple[bytes, int]] = {}

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best path; of equal ones, that whose last piece starts first."""
        n, low = len(unit), float("-inf")
        best, back, piece = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.scores
        codes, size = [self.trie.code.get(c, -1) for c in unit], len(check)
        for at in range(n):
            here, single, state = best[at], False, 0
            for end in range(at, n):  # the walk of ``DoubleArray.prefixes``
                child = base[state] + codes[end]
                if codes[end] < 0 or child >= size or child == 0 or check[child] != state:
                    break
                state, i = child, value[child]
                if i >= 0:
                    single |= end == at
                    if (s := here + score[i]) > best[end + 1]:
                        best[end + 1], back[end + 1], piece[end + 1] = s, at, i
            if not single and (s := here + self.fallback) > best[at + 1]:
                best[at + 1], back[at + 1], piece[at + 1] = s, at, -1
        out: list[int] = []
        while n:
            got = [piece[n]] if piece[n] >= 0 else [self.pieces.byte_id[b] for b in unit[back[n] : n].encode("utf-8", "surrogatepass")]
            out += reversed(got)
            n = back[n]
        return out[::-1]

    def encode_unit(self, unit: str) -> tuple[bytes, int]:
        """Little-endian ids, and how many of them are bytes."""
        found = self.known.get(unit)
        if found is None:
            ids = self.viterbi(unit)
            found = np.array(ids, "<u4").tobytes(), sum(i in self.byte_ids for i in ids)
            if len(self.known) < 4 * CACHE_ENTRIES and len(unit) <= 64:
                self.known[unit] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.encode_unit(u)[0] for u in units(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, markers as spaces, the marker put first taken off."""
        s = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return s[1:] if s[:1] == " " else s


def model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; null and empty texts have no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [m.encode(t) for t in b["text"].fillna("")]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``text`` of every row of ids; a null array gives an empty text. A text in which a
    user's own U+2581 stood comes back with spaces there, as the model can't tell them apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [m.decode([] if i is None else list(i)) for i in b["ids"]]})

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def encode_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of encoding and decoding each whole text: doc_id, n_chars, n_pieces, n_byte_pieces,
    ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text again, with
    U+2581 read as a space). Null texts count as empty, texts of any length are read whole, repeated rows alike; an empty table
    gives no rows. Of equally good paths the one whose last piece starts first is taken. Needs no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"].fillna("")):
                got = [m.encode_unit(u) for u in units(t)]
                raw = b"".join([g[0] for g in got])
                back = m.decode(np.frombuffer(raw, "<u4").tolist())
                rows.append((i, len(t), len(raw) // 4, sum([g[1] for g in got]), zlib.crc32(raw), back == t.replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
