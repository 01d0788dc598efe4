"""Scorers by name: a scorer takes (events, queries) and returns eid, k and its columns; users add their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from chronoweft.operators import collaborative as C
from chronoweft.operators import scorers as S

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
#: Scorers by the columns they give.
SCORERS: dict[tuple[str, ...], Scorer] = {
    ("recency", "past"): S.pair_history, ("popularity", "global_recency"): S.target_history, ("recent_degree",): lambda e, q: S.recent_degree(e, q, 90), ("cn", "aa", "ra"): S.common_neighbors,
    ("markov",): S.markov, ("item_cf",): C.item_cf, ("user_cf",): C.user_cf, ("ppr",): C.sampled_pagerank,
}
#: Of scorers that look up what a query's own columns name: functions of (events, queries, rows) that add the columns to rows of the queries, without a join by query.
ADDING: dict[Scorer, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {S.pair_history: S.add_pair_history, S.target_history: S.add_target_history, S.common_neighbors: S.add_common_neighbors}


def register(columns: Sequence[str], scorer: Scorer) -> None:
    SCORERS[tuple(columns)] = scorer


def scores(events: DataFrame, q: DataFrame, names: Sequence[str]) -> DataFrame:
    """``q`` with the named columns; each scorer that gives any of them runs once."""
    known = {c for columns in SCORERS for c in columns}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"no scorer gives {missing}; known are {sorted(known)}")
    out = q
    for columns, scorer in SCORERS.items():
        if wanted := [c for c in columns if c in names]:
            if scorer in ADDING:
                out = ADDING[scorer](events, q, out).select(*out.columns, *wanted)
            else:
                out = out.join(scorer(events, q).select(*S.KEY, *wanted), S.KEY)
    return out
