"""Isotonic alignment of scores: pooling of adjacent violators over ranges, and its use by an as-of lookup.

Equal scores are one point with a weight. Points in the order of the score lie in groups of bounded size; a task pools its own. Pools of neighbouring groups may violate the order
still, so what is left, one row for each pool, is dealt out anew, by half a group further, until no two neighbours do. Pooling may go in any order with the same end, and
every round leaves fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.prefix import row_numbers
from chronoweft.sources.written import written

#: Points or pools that one task holds.
GROUP = 1 << 18


def pool(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[list, list, list, list]:
    """Neighbouring pools whose means fall are made one, until none do."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    a, b, w, s = out
    for x, y, n, t in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        while w and s[-1] * n > t * w[-1]:  # the mean before is larger
            x, n, t = a.pop(), n + w.pop(), t + s.pop()
            b.pop()
        for column, v in zip(out, (x, y, n, t)):
            column.append(v)
    return out


def _pooled(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("low")
    a, b, w, s = pool(*(g[c].to_numpy() for c in ("low", "high", "w", "s")))
    return pd.DataFrame({"group": g["group"].iloc[0], "low": a, "high": b, "w": w, "s": s})


def fit_isotonic(rows: DataFrame, x: str, y: str, group: int = GROUP) -> DataFrame:
    """n (from 0, in order), low, high, value: the pools of the non-decreasing fit of ``y`` on ``x``, from their first to their last score. Rows with a
    null are left out."""
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("low")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s"))
    points, shift = points.select("low", F.col("low").alias("high"), "w", "s"), 0
    while True:
        placed = row_numbers(points, [F.col("low")], "n").withColumn("group", F.floor((F.col("n") + shift) / group))
        points = written(placed.groupBy("group").applyInPandas(_pooled, "group long, low double, high double, w double, s double"), "pools")
        mean = F.col("s") / F.col("w")
        ends = points.groupBy("group").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        before = F.lag("last").over(Window.orderBy("group"))  # one row for each group
        if not ends.withColumn("before", before).where("before > first").limit(1).count():
            return written(row_numbers(points.select("low", "high", mean.alias("value")), [F.col("low")], "n"), "fit")
        points, shift = points.drop("group"), group // 2 - shift


def apply_isotonic(rows: DataFrame, score: str, fit: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the fit at each score, linear between pools, flat outside them; null for a null score. A score's pool is found by one running maximum over scores and
    pools in their order, by ranges of it."""
    asked = rows.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("at")).distinct().withColumns({"own": F.lit(None).cast("long"), "kind": F.lit(1)})
    both = fit.select(F.col("low").alias("at"), F.col("n").alias("own"), F.lit(0).alias("kind")).unionByName(asked.select("at", "own", "kind"))
    parts = written(both.repartitionByRange("at", "kind").withColumn("part", F.spark_partition_id()), "score-ranges")
    ends = parts.groupBy("part").agg(F.max("own").alias("last"))
    earlier = ends.withColumn("earlier", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "earlier")  # one row for each range
    here = F.max("own").over(Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = parts.withColumn("here", here).where("kind = 1").join(F.broadcast(earlier), "part").select("at", F.coalesce("here", "earlier").alias("n"))
    one = found.join(fit.select("n", "high", F.col("value").alias("a")), "n", "left").withColumn("next", F.coalesce(F.col("n") + 1, F.lit(0)))
    two = one.join(fit.select(F.col("n").alias("next"), F.col("low").alias("to"), F.col("value").alias("b")), "next", "left")
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("high")) / (F.col("to") - F.col("high"))
    value = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("at") <= F.col("high")), F.col("a")).otherwise(between)
    return rows.withColumn("_at", F.col(score).cast("double")).join(two.select(F.col("at").alias("_at"), value.alias(name)), "_at", "left").drop("_at")
