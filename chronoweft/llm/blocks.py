"""What the block tasks of the pair operators share: spanning forests of a block's links."""

from __future__ import annotations

import numpy as np


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix: at most one per row, whatever the
    number of links."""
    out, open_ = [], np.ones(len(linked), bool)
    while open_.any():
        frontier = [int(open_.argmax())]
        open_[frontier[0]] = False
        while frontier:
            at = frontier.pop()
            new = np.flatnonzero(linked[at] & open_)
            open_[new] = False
            out += [(at, int(i)) for i in new]
            frontier += new.tolist()
    return out


def forest_between(linked: np.ndarray) -> list[tuple[int, int]]:
    """The same for links between two blocks: (row, column) edges of a forest of a rectangular matrix."""
    m, n = linked.shape
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    both = np.zeros((len(rows) + len(cols),) * 2, bool)
    both[: len(rows), len(rows) :] = linked[np.ix_(rows, cols)]
    both |= both.T
    return [(int(rows[min(a, b)]), int(cols[max(a, b) - len(rows)])) for a, b in forest(both)]
