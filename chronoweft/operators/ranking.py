"""Ranks, rank fusion, calibration, routing, and tie-aware ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.prefix import quantiles, running_totals


def descending_rank(score: str, by: Sequence[str], tie: str = "k") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))


def reciprocal_rank_fusion(scores: DataFrame, columns: Sequence[str], by: Sequence[str] = ("eid",), k: int = 60, tie: str = "k") -> DataFrame:
    """``rrf``: sum of 1 / (k + rank) over the score columns, ranked within each query."""
    return scores.withColumn("rrf", sum((1 / (F.lit(k) + descending_rank(c, by, tie)) for c in columns), F.lit(0.0)))


def cumulative_by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: positives and negatives at it, and cumulative ones from the top."""
    counts = rows.groupBy(score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    return running_totals(counts, [F.desc(score)], {"tp": "p", "fp": "n"})


def auc_and_ap(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Tie-aware ROC-AUC (ties count half) and threshold-grouped average precision; null without both labels."""
    c = cumulative_by_score(rows, score, label)
    totals = F.nullif(F.sum("p") * F.sum("n"), F.lit(0))
    return c.agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / totals).alias("auc"), (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def mrr_and_hits(rows: DataFrame, score: str, by: Sequence[str] = ("eid",), hits: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """MRR with pessimistic ties (neg >= pos) and Hits@k with optimistic ones (neg > pos); positives have k = 0."""
    pos = F.max(F.when(F.col("k") == 0, F.col(score))).over(Window.partitionBy(*by))
    negatives = rows.withColumn("_pos", pos).where("k > 0")
    per = negatives.groupBy(*by).agg(F.sum((F.col(score) >= F.col("_pos")).cast("int")).alias("ge"), F.sum((F.col(score) > F.col("_pos")).cast("int")).alias("gt"))
    return per.agg(F.avg(1 / (1 + F.col("ge"))).alias("mrr"), *(F.avg((F.col("gt") < h).cast("double")).alias(f"hits_{h}") for h in hits))


def minmax(rows: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` scaled by bounds fitted elsewhere (one row of min_c, max_c) and clipped; no range: divide by 1."""
    out = rows.join(F.broadcast(bounds))
    scaled = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col(f"min_{c}")) / F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")).otherwise(1.0))) for c in columns}
    return out.select(*(c for c in rows.columns if c not in columns), *(v.alias(c) for c, v in scaled.items()))


def fit_bounds(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def levels(s: Column, low: float | None, high: float | None) -> Column:
    """High from the upper bound on, Low up to the lower one, else Modest, also where the bounds are equal or the value is missing."""
    if low is None or low == high:
        return F.lit("Modest")
    return F.when(s.isNull(), "Modest").when(s >= high, "High").when(s <= low, "Low").otherwise("Modest")


def level_buckets(rows: DataFrame, score: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """``level`` of each row by the quantiles of the scores."""
    return rows.withColumn("level", levels(F.col(score), *quantiles(rows, score, [low, high])))


def balanced_threshold(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The best of (TPR + TNR) / 2 over the distinct scores as thresholds (score >= threshold); of equally good ones the lowest."""
    c = cumulative_by_score(rows, score, label)
    totals = c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    value = (F.col("tp") / F.col("all_p") + 1 - F.col("fp") / F.col("all_n")) / 2
    return c.join(F.broadcast(totals)).select(F.col(score).alias("threshold"), F.round(value, 9).alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)


def middle_band(rows: DataFrame, score: str, batch: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k middle rows of each batch by ascending score: from position (n - k) // 2."""
    w = Window.partitionBy(batch)
    out = rows.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy(score, *tie)) - 1)
    first = F.greatest(F.floor((F.col("n") - k) / 2), F.lit(0))
    return out.where((F.col("at") >= first) & (F.col("at") < first + k)).drop("n", "at")


def ks_distance(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Largest gap of the two groups' empirical distributions (group 0 and 1)."""
    cum = cumulative_by_score(rows, value, group)
    totals = cum.agg(F.sum("n").alias("tn"), F.sum("p").alias("tp_"))
    return cum.join(F.broadcast(totals)).agg(F.max(F.abs(F.col("fp") / F.col("tn") - F.col("tp") / F.col("tp_"))).alias("ks"))


def percentile_of(rows: DataFrame, reference: DataFrame, value: str, invert: bool = False) -> DataFrame:
    """``percentile``: mid-rank among the reference values over n - 1, times 100; 50 for a reference of one or none; from the other
    end with ``invert``."""
    counts = reference.groupBy(value).agg(F.count("*").alias("c"))
    both = counts.select(value, "c").unionByName(rows.select(value).distinct().withColumn("c", F.lit(0).cast("long"))).groupBy(value).agg(F.sum("c").alias("c"))
    cum = running_totals(both, [F.col(value)], {"le": "c"})
    n = reference.agg(F.count("*").alias("n"))
    place = F.greatest(F.lit(0.0), F.least(F.lit(100.0), ((F.col("le") - F.col("c") + F.col("le") - 1) / 2) / (F.col("n") - 1) * 100))
    ranked = cum.join(F.broadcast(n)).select(value, F.when(F.col("n") <= 1, 50.0).otherwise(100 - place if invert else place).alias("percentile"))
    return rows.join(ranked, value)


def confusion_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Macro, micro and weighted precision, recall and F1 over the classes that occur."""
    pairs = rows.groupBy(label, predicted).agg(F.count("*").alias("c"))
    by = lambda c, n: pairs.groupBy(F.col(c).alias("y")).agg(F.sum("c").alias(n))
    hit = pairs.where(F.col(label) == F.col(predicted)).select(F.col(label).alias("y"), F.col("c").alias("tp"))
    k = by(label, "support").join(by(predicted, "given"), "y", "full").join(hit, "y", "left").na.fill(0)
    p, r = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    k = k.select("support", "tp", p.alias("p"), r.alias("r")).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return k.agg(F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.avg("f").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("micro_f1"), weighted("p").alias("weighted_p"), weighted("f").alias("weighted_f1"))


def wasserstein(rows: DataFrame, value: str, group: str, levels: int = 257) -> float | None:
    """Mean absolute gap of the two groups' linear quantiles at evenly spaced levels (group 0 and 1); null if one has no rows."""
    at = [j / (levels - 1) for j in range(levels)]
    a, b = (quantiles(rows.where(F.col(group) == g), value, at) for g in (0, 1))
    return None if a[0] is None or b[0] is None else sum(abs(x - y) for x, y in zip(a, b)) / levels


def closest_to_median(rows: DataFrame, score: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows nearest to the median score, ties by ``tie``."""
    (mid,) = quantiles(rows, score, [0.5])
    return rows.withColumn("gap", F.abs(F.col(score) - F.lit(mid))).orderBy("gap", *tie).limit(k).drop("gap")


def batch_auc(rows: DataFrame, score: str, label: str, batch: str) -> DataFrame:
    """Tie-aware AUC of each batch that has both labels."""
    counts = rows.groupBy(batch, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    w = Window.partitionBy(batch).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumn("tp", F.sum("p").over(w)).groupBy(batch)
    return c.agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc")).where("auc is not null")
