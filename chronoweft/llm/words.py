"""Distinct words of a worker and a vector for each, computed once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: UTF-8 bytes of a segment at most; longer words are several segments, so no byte is left out.
SEGMENT = 32


def segments(text: str) -> list[str]:
    """White-space separated words; words of more than 32 characters in pieces of 32."""
    words = text.split()
    if max(map(len, words), default=0) <= SEGMENT:
        return words
    return [w[i : i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)]


class WordTable:
    """Rows of ``make(words)`` by word. A table over its size starts again: only time depends on that."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], entries: int):
        self.make, self.entries = make, entries
        self.at: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row number of each word, the rows)."""
        if len(self.at) > self.entries:
            self.at, self.rows = {}, None
        at = self.at
        fresh = list(dict.fromkeys(w for w in words if w not in at))
        if fresh or self.rows is None:
            made = np.concatenate([self.make(fresh[i : i + 16384]) for i in range(0, max(1, len(fresh)), 16384)])
            used = len(at)
            if self.rows is None or used + len(fresh) > len(self.rows):
                grown = np.empty((max(1024, 2 * (used + len(fresh))), made.shape[1]), made.dtype)
                grown[:used] = self.rows[:used] if used else grown[:0]
                self.rows = grown
            self.rows[used : used + len(fresh)] = made
            at.update(zip(fresh, range(used, used + len(fresh))))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words)), self.rows


def byte_matrix(words: list[str], width: int) -> np.ndarray:
    """UTF-8 bytes of words of at most ``width`` bytes, zero-filled: [words, width] uint8."""
    joined = b"".join(w.ljust(width, b"\0") for w in (x.encode("utf-8", "replace") for x in words))
    return np.frombuffer(joined, np.uint8).reshape(len(words), width)
