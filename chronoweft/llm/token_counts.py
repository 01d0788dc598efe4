"""Token counts: the exact count at every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding the encoding of a prefix, without its last token, is again the encoding of a
shorter prefix, and a sequence of tokens is an encoding exactly when each neighbouring pair is. So the
count at a prefix is one more than the count at the prefix before its last token, and the last token is
the one suffix that pairs with the last token found there. Counts at all prefixes answer "how many
tokens has the text up to here" and "where must it be cut for a budget" without encoding again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import CACHE_ENTRIES
from chronoweft.llm.pieces import Pieces, units

#: Characters of a beginning whose counts are kept, and units whose totals are (about 160 bytes each).
STEM, UNITS_KNOWN = 7, 1_500_000
_counters: dict[str, PrefixCounter] = {}


class PrefixCounter:
    """Prefix counts of units and texts under a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.after: dict[str, dict[str, int]] = {}  # weights of last pieces by the piece before
        self.kept = 0
        self.totals: dict[str, int] = {}
        self.stems: dict[str, tuple[list[int], list[str]]] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text: join the neighbours of the best score, leftmost first."""
        parts, score, none = list(text), self.pieces.score.get, float("-inf")
        joined = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (best := max(joined)) > none:
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def weight(self, a: str, b: str) -> int:
        """Tokens that ``b`` adds as the last piece after ``a``: 0 if the two aren't neighbours in any
        encoding, 1 for a piece, the number of its bytes for a character without one."""
        known = b in self.pieces.score
        n = 0
        if (known or len(b) == 1) and self.merge(a + b) == ([a, b] if a else [b]):
            n = 1 if known else len(b.encode("utf-8", "surrogatepass"))
        if self.kept < 2 * CACHE_ENTRIES:
            self.kept += 1
            self.after.setdefault(a, {})[b] = n
        return n

    def unit_counts(self, unit: str) -> list[int]:
        """Tokens of ``unit[:i]`` for i from 0 to its length."""
        # words share beginnings, and the counts of a beginning are those of the word up to there
        stem = self.stems.get(unit[:STEM])
        counts, last = (stem[0].copy(), stem[1].copy()) if stem else ([0], [""])
        longest, after, none = self.pieces.longest, self.after.get, {}
        rows = [after(a, none) for a in last]
        for i in range(len(counts), len(unit) + 1):
            for at in range(i - 1, max(0, i - longest) - 1, -1):  # short ones first: most last tokens are short
                t = unit[at:i]
                n = rows[at].get(t)
                if n is None:
                    n = self.weight(last[at], t)
                if n:
                    counts.append(counts[at] + n)
                    last.append(t)
                    rows.append(after(t, none))
                    break
            else:
                raise AssertionError(f"no encoding ends at {i} of {unit!r}")
        if not stem and len(unit) >= STEM and len(self.stems) < CACHE_ENTRIES // 2:
            self.stems[unit[:STEM]] = counts[: STEM + 1], last[: STEM + 1]
        return counts

    def count(self, text: str | None) -> int:
        """Tokens of a text: the last prefix counts of its units, which are kept by unit."""
        all_units, totals = units(text), self.totals
        found = list(map(totals.get, all_units))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    found[i] = n = self.unit_counts(u := all_units[i])[-1]
                    if len(totals) < UNITS_KNOWN and len(u) <= 64:
                        totals[u] = n
        return sum(found)

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of ``text[:i]`` for every i from 0 to its length; [0] for null and empty texts."""
        out, base = [0], 0
        for u in units(text):
            c = self.unit_counts(u)
            out += [base + n for n in c[1:]]
            base += c[-1]
        return [0, *out[2:]]  # the marker put first stands for no character of the text

    def cut_for(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix up to which every prefix has at most ``budget`` tokens."""
        return bisect_right(list(accumulate(self.prefix_counts(text), max)), budget) - 1


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``), cut_chars (characters that fit
    into ``limit``; the whole length where all do) for every row of ``docs``.

    Null and empty texts: 0 bytes and tokens; texts of any length are counted whole, repeated rows each; an empty table gives no rows, and
    other columns are not looked at. Needs no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(model_path)
        for b in batches:
            texts = b["text"].fillna("").tolist()
            n = [c.count(t) for t in texts]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
                "cut_chars": [c.cut_for(t, limit) if x > limit else len(t) for t, x in zip(texts, n)],
            })

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``counts``, the stored array of token counts at every prefix (by characters)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "counts": [c.prefix_counts(t) for t in b["text"].fillna("")]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, counts array<int>")
