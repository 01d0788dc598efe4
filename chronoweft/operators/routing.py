"""Routing a budget of rows, aligning and merging scores, thresholds, calibration and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.calibration import earlier_quantiles, earlier_share
from chronoweft.operators.prefix import first_rows, quantiles, row_numbers, running_totals
from chronoweft.operators.ranking import auc_and_ap, balanced_threshold, cumulative_by_score, levels
from chronoweft.sources.tables import draw
from chronoweft.sources.written import written

#: Rows of a table of distinct values that is broadcast.
HELD = 1 << 20


def minmax_scores(rows: DataFrame, score: str, name: str) -> DataFrame:
    """``name``: the score over the range of all scores; 0.5 where all are equal."""
    bounds = rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return rows.join(F.broadcast(bounds)).withColumn(name, scaled).drop("_lo", "_hi")


def budget(fraction: float, n: int) -> int:
    """Rows of a share: rounded, one at least unless the share is 0."""
    wanted = min(1.0, max(0.0, fraction))
    return min(n, max(1, round(wanted * n))) if wanted > 0 else 0


def random_budget(rows: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the rows, those of the least draws of (eid, k)."""
    return first_rows(rows, [draw(F.col("eid"), F.col("k"), F.lit(2147483647), seed), F.col("eid"), F.col("k")], budget(fraction, rows.count()))


def top_rows(rows: DataFrame, priority: str, n: int, tie: Sequence[str] = ("eid", "k")) -> DataFrame:
    return first_rows(rows, [F.desc(priority), *map(F.col, tie)], n)


def core_and_shell(rows: DataFrame, uncertainty: str, learned: str, route: int, core: int, candidates: int, tie: Sequence[str] = ("eid", "k")) -> DataFrame:
    """``route`` rows with ``part``: the ``core`` most uncertain, and from the next ones, up to ``candidates`` in all, those of the largest learned value."""
    near = written(row_numbers(rows, [F.desc(uncertainty), *map(F.col, tie)], "_turn").where(F.col("_turn") < candidates), "candidates")
    inner = near.where(F.col("_turn") < core).withColumn("part", F.lit("core"))
    outer = top_rows(near.where(F.col("_turn") >= core), learned, route - core, tie).withColumn("part", F.lit("shell"))
    return inner.unionByName(outer).drop("_turn")


def threshold_band(rows: DataFrame, score: str, low: float, high: float) -> DataFrame:
    if not low < high:
        raise ValueError("the band needs low < high")
    return rows.where((F.col(score) >= low) & (F.col(score) < high))


def uncertainty_band(rows: DataFrame, score: str, label: str, fraction: float) -> DataFrame:
    """One row: the best balanced threshold, and the bounds of the share of the rows nearest to it, the upper one just above the largest."""
    import numpy as np

    center = balanced_threshold(rows, score, label).first()["threshold"]
    n = rows.count()
    wanted = budget(fraction, n)
    chosen = first_rows(rows.withColumn("_gap", F.abs(F.col(score) - center)), [F.col("_gap"), F.col("eid"), F.col("k")], wanted).agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    low, high = (float(center), float(center)) if not wanted else (float(chosen["lo"]), float(np.nextafter(float(chosen["hi"]), np.inf)))
    inside = (F.col(score) >= low) & (F.col(score) < high)
    return rows.agg(
        F.lit(float(center)).alias("center"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(wanted).cast("long").alias("requested"),
        F.count_if(inside).alias("selected"), F.avg(F.when(inside, F.col(label).cast("double"))).alias("positive_rate"),
    )


def three_way_thresholds(rows: DataFrame, score: str, label: str, low: float, high: float) -> tuple[float, float, bool]:
    """(low, high, collapsed): a quantile of the negatives and one of the positives; where they cross, the best balanced threshold for both."""
    (a,), (b,) = (quantiles(rows.where(F.col(label) == y), score, [q]) for y, q in ((0, low), (1, high)))
    if a is None or b is None:
        raise ValueError("calibration needs positive and negative rows")
    if a > b:
        middle = float(balanced_threshold(rows, score, label).first()["threshold"])
        return middle, middle, True
    return a, b, False


def three_way_report(rows: DataFrame, score: str, label: str, low: float, high: float) -> DataFrame:
    """Thresholds with the coverage of the three parts, and how right the outer two are."""
    a, b, collapsed = three_way_thresholds(rows, score, label, low, high)
    s, y = F.col(score), F.col(label)
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(collapsed).alias("collapsed"), share(s < a).alias("low_coverage"), share((s >= a) & (s < b)).alias("middle_coverage"), share(s >= b).alias("high_coverage"),
        F.avg(F.when(s < a, 1.0 - y)).alias("low_negative_rate"), F.avg(F.when(s >= b, y.cast("double"))).alias("high_positive_rate"),
    )


def binary_report(rows: DataFrame, score: str, label: str) -> DataFrame:
    t = balanced_threshold(rows, score, label).select("threshold")
    hit = F.col(score) >= F.col("threshold")
    joined = rows.join(F.broadcast(t))
    tpr, tnr = F.avg(F.when(F.col(label) == 1, hit.cast("double"))), F.avg(F.when(F.col(label) == 0, (~hit).cast("double")))
    return joined.agg(F.first("threshold").alias("threshold"), tpr.alias("tpr"), tnr.alias("tnr"), ((tpr + tnr) / 2).alias("balanced_accuracy"), F.avg(hit.cast("double")).alias("positive_rate"))


def mixture(rows: DataFrame, score: str, rounds: int = 100, tolerance: float = 1e-6, floor: float = 1e-6) -> dict:
    """Two normal components of a score, by expectation and maximisation from the quartiles; a round is one aggregate over the counts of the
    distinct scores. weights, means, variances by mean, and the number of rounds."""
    import math

    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(F.count("*").alias("c")).cache()
    n, distinct, mean, square = counts.agg(F.sum("c"), F.count("*"), F.sum(F.col("c") * F.col("x")) / F.sum("c"), F.sum(F.col("c") * F.col("x") ** 2) / F.sum("c")).first()
    if not n:
        raise ValueError("a mixture needs scores")
    spread = max(counts.agg(F.sum(F.col("c") * (F.col("x") - mean) ** 2) / F.sum("c")).first()[0], floor)
    if distinct == 1:
        return {"weights": [0.5, 0.5], "means": [mean, mean], "variances": [spread, spread], "rounds": 0}
    means, variances, weights = quantiles(rows, score, [0.25, 0.75]), [spread, spread], [0.5, 0.5]
    before, done = None, 0
    for done in range(1, rounds + 1):
        density = [F.lit(w / math.sqrt(2 * math.pi * v)) * F.exp(-0.5 * (F.col("x") - m) ** 2 / v) for w, m, v in zip(weights, means, variances)]
        both = F.greatest(density[0] + density[1], F.lit(1e-300))
        parts = counts.select("x", "c", both.alias("d"), *((p / both * F.col("c")).alias(f"r{i}") for i, p in enumerate(density)))
        got = parts.agg(*(F.sum(F.col(f"r{i}") * F.col("x") ** p).alias(f"s{i}{p}") for i in (0, 1) for p in (0, 1)), F.sum(F.log("d") * F.col("c")).alias("fit")).first()
        mass = [max(got[f"s{i}0"], 1e-12) for i in (0, 1)]
        weights, means = [m / n for m in mass], [got[f"s{i}1"] / mass[i] for i in (0, 1)]
        around = parts.agg(*(F.sum(F.col(f"r{i}") * (F.col("x") - means[i]) ** 2).alias(f"v{i}") for i in (0, 1))).first()
        variances = [max(around[f"v{i}"] / mass[i], floor) for i in (0, 1)]
        if before is not None and abs(got["fit"] - before) <= tolerance:
            break
        before = got["fit"]
    counts.unpersist()
    order = sorted((0, 1), key=lambda i: means[i])
    return {"weights": [weights[i] for i in order], "means": [means[i] for i in order], "variances": [variances[i] for i in order], "rounds": done}


def overlap(score: Column, fit: dict) -> Column:
    """1 less the gap of the two components' responsibilities for a score."""
    import math

    a, b = (F.lit(w / math.sqrt(2 * math.pi * max(v, 1e-12))) * F.exp(-0.5 * (score - m) ** 2 / max(v, 1e-12)) for w, m, v in zip(fit["weights"], fit["means"], fit["variances"]))
    return 1 - F.abs(a - b) / F.greatest(a + b, F.lit(1e-300))


def align_by_quantile(rows: DataFrame, score: str, target: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the linear quantile of the target's values at the score's mean rank among all scores."""
    counts = rows.groupBy(score).agg(F.count("*").alias("c"))
    ranked = running_totals(counts, [F.col(score)], {"upto": "c"})
    n, m = rows.count(), target.count()
    level = F.lit(0.0) if n <= 1 else (F.col("upto") - F.col("c") + F.col("upto") - 1) / 2 / (n - 1)
    spots = ranked.select(score, (level * (m - 1)).alias("_place")).withColumn("_low", F.floor("_place"))
    held = running_totals(target.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c")), [F.col("_v")], {"_upto": "_c"})
    # places are dealt out by blocks of rows, so that a value meets the places in its own blocks only
    width = 1024
    blocks = held.select("_v", (F.col("_upto") - F.col("_c")).alias("_from"), "_upto").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_upto") - 1) / width))))

    def at(place: str, out: str) -> DataFrame:
        asked = spots.select(score, F.least(F.col(place), F.lit(m - 1)).alias("_p")).withColumn("_block", F.floor(F.col("_p") / width))
        return asked.join(blocks, "_block").where((F.col("_p") >= F.col("_from")) & (F.col("_p") < F.col("_upto"))).select(score, F.col("_v").alias(out))

    spots = spots.withColumn("_next", F.col("_low") + 1)
    low, high = at("_low", "_a"), at("_next", "_b")
    found = spots.join(low, score).join(high, score).select(score, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.col("_low"))).alias(name))
    return rows.join(found, score)


def rank_graft(rows: DataFrame, base: str, order: str, name: str, by: Sequence[str], tie: Sequence[str] = ("eid", "k")) -> DataFrame:
    """``name``: the base scores of each group dealt out anew, largest first, in the order of another score."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_turn", F.row_number().over(w.orderBy(F.desc(order), *tie)))
    values = rows.select(*by, F.col(base).alias(name), F.row_number().over(w.orderBy(F.desc(base), *tie)).alias("_turn"))
    return ranked.join(values, [*by, "_turn"]).drop("_turn")


def merge(rows: DataFrame, base: str, other: str, alpha: float, name: str) -> DataFrame:
    """``name``: alpha parts of another score, where there is one, and the rest of the base score; 1 replaces it."""
    a = min(1.0, max(0.0, alpha))
    return rows.withColumn(name, F.when(F.col(other).isNull(), F.col(base)).otherwise(a * F.col(other) + (1 - a) * F.col(base)))


def one_vs_one(rows: DataFrame, score: str, by: str = "eid") -> DataFrame:
    """Tie-aware AUC and average precision of each query's positive (k = 0) and first negative."""
    w = Window.partitionBy(by, F.col("k") == 0).orderBy("k")
    first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    whole = first.withColumn("_both", F.count("*").over(Window.partitionBy(by))).where(F.col("_both") == 2)
    return auc_and_ap(whole.withColumn("label", (F.col("k") == 0).cast("int")), score)


def metric_report(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: one-to-one AUC and AP, those of all rows, accuracy at 0.5 and the counts; where one-to-one ones do not exist, those of all."""
    paired, everything = one_vs_one(rows, score), auc_and_ap(rows, score, label)
    counts = rows.agg(F.avg((((F.col(score) > 0.5).cast("int")) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("samples"), F.sum(label).alias("positives"), F.sum(1 - F.col(label)).alias("negatives"))
    out = counts.join(everything.withColumnsRenamed({"auc": "auc_global", "ap": "ap_global"})).join(paired)
    return out.withColumns({"auc": F.coalesce("auc", "auc_global"), "ap": F.coalesce("ap", "ap_global")})


def time_buckets(rows: DataFrame, score: str, buckets: int) -> DataFrame:
    """Queries in buckets between even quantiles of their times (the last one closed), with AUC, AP and pessimistic MRR of each."""
    edges = quantiles(rows.where("k = 0"), "t", [j / buckets for j in range(buckets + 1)])
    number = F.lit(None).cast("int")
    for j in range(buckets):
        upper = F.col("t") <= edges[j + 1] if j == buckets - 1 else F.col("t") < edges[j + 1]
        number = F.when((F.col("t") >= edges[j]) & upper, j + 1).otherwise(number)
    placed = rows.withColumn("bucket", number).where("bucket is not null").withColumn("label", (F.col("k") == 0).cast("int"))
    pos = F.max(F.when(F.col("k") == 0, F.col(score))).over(Window.partitionBy("eid"))
    rr = placed.withColumn("_pos", pos).groupBy("bucket", "eid").agg((1 / (1 + F.sum(((F.col("k") > 0) & (F.col(score) >= F.col("_pos"))).cast("int")))).alias("rr")).groupBy("bucket").agg(F.count("*").alias("queries"), F.avg("rr").alias("mrr"))
    counts = placed.groupBy("bucket", score).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w = Window.partitionBy("bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)}).groupBy("bucket").agg(
        (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"), (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("ap"))
    return rr.join(c, "bucket")


def marginal_utility(rows: DataFrame, base: str, other: str, label: str = "label") -> DataFrame:
    """``utility``: how the share of right pairs changes when a row's base score is replaced by the other one, against the base scores of the other
    label, ties counting half."""
    c = cumulative_by_score(rows, base, label).select(F.col(base).cast("double").alias("s"), "p", "n")
    asked = rows.select(F.col(base).cast("double").alias("s")).union(rows.select(F.col(other).cast("double"))).distinct()
    grid = c.unionByName(asked.select("s", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))).groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    cum = running_totals(grid, [F.col("s")], {"pp": "p", "nn": "n"})
    totals = grid.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    rates = written(cum.join(F.broadcast(totals)).select("s", ((F.col("nn") - F.col("n") / 2) / F.col("tn")).alias("above"), ((F.col("tp") - F.col("pp") + F.col("p") / 2) / F.col("tp")).alias("below")), "rates")
    # few values that many rows have go to the rows, which then do not gather by value
    held = F.broadcast(rates) if rates.count() <= HELD else rates
    one = lambda column, tag: held.select(F.col("s").alias(column), F.col("above").alias(f"above_{tag}"), F.col("below").alias(f"below_{tag}"))
    out = rows.withColumns({"_b": F.col(base).cast("double"), "_o": F.col(other).cast("double")}).join(one("_b", "b"), "_b").join(one("_o", "o"), "_o")
    change = F.when(F.col(label) == 1, F.col("above_o") - F.col("above_b")).otherwise(F.col("below_o") - F.col("below_b"))
    return out.withColumn("utility", change).drop("_b", "_o", "above_b", "below_b", "above_o", "below_o")


def level_table(rows: DataFrame, level: str, label: str) -> DataFrame:
    """Rows, coverage and share of positives of each level."""
    total = rows.agg(F.count("*").alias("_all"))
    return rows.groupBy(level).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate")).join(F.broadcast(total)).withColumn("coverage", F.col("n") / F.col("_all")).drop("_all")


def policy_change(rows: DataFrame, base: str, hybrid: str, label: str = "label") -> DataFrame:
    """AUC and AP of two policies' scores on the same rows, and the change."""
    a, b = auc_and_ap(rows, base, label).withColumnsRenamed({"auc": "base_auc", "ap": "base_ap"}), auc_and_ap(rows, hybrid, label)
    return a.join(b).select("base_auc", "base_ap", "auc", "ap", (F.col("auc") - F.col("base_auc")).alias("auc_change"), (F.col("ap") - F.col("base_ap")).alias("ap_change"))


def sequential_levels(rows: DataFrame, value: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """``level`` of each row by the quantiles of the values at earlier times only; Modest before there are any."""
    found = earlier_quantiles(rows, value, [low, high])
    v = F.col(value)
    level = F.when(F.col("q0").isNull() | (F.col("q0") == F.col("q1")) | v.isNull(), "Modest").when(v >= F.col("q1"), "High").when(v <= F.col("q0"), "Low").otherwise("Modest")
    return rows.join(found, "t", "left").withColumn("level", level).drop("q0", "q1")


def frozen_levels(rows: DataFrame, reference: DataFrame, value: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """``level`` by the quantiles of a reference, which stay as they are."""
    return rows.withColumn("level", levels(F.col(value), *quantiles(reference, value, [low, high])))


def expert_labels(rows: DataFrame, score: str, mode: str = "global", threshold: float | None = None) -> DataFrame:
    """``expert``: Yes from the threshold on, else No. The threshold is the median of all scores (global), that of the earlier ones (running; Unknown
    before there are any), or given (fixed)."""
    if mode == "running":
        found = earlier_quantiles(rows, score, [0.5])
        return rows.join(found, "t", "left").withColumn("expert", F.when(F.col("q0").isNull(), "Unknown").when(F.col(score) >= F.col("q0"), "Yes").otherwise("No")).drop("q0")
    if mode == "global":
        (threshold,) = quantiles(rows, score, [0.5])
    if threshold is None:
        raise ValueError("a fixed label needs a threshold, a global one rows")
    return rows.withColumn("expert", F.when(F.col(score) >= threshold, "Yes").otherwise("No"))


def sequential_pseudo_rank(rows: DataFrame, score: str, bins: int) -> DataFrame:
    """``pseudo_rank`` from 1 (best) to ``bins`` by the share of earlier scores up to the row's: round((1 - share)(bins - 1)) + 1, and (bins + 1) // 2
    before there are any."""
    share = earlier_share(rows, score).select("t", F.col("v").alias(score), F.col("share").alias("_share"))
    rank = F.floor((1 - F.col("_share")) * (bins - 1) + 0.5) + 1
    return rows.join(share, ["t", score], "left").withColumn("pseudo_rank", F.coalesce(rank, F.lit((bins + 1) // 2))).drop("_share")


def fuse_in_batches(rows: DataFrame, columns: Sequence[str], batch: str, k: int = 60) -> DataFrame:
    """``rrf`` of each query's positive and first negative (k up to 1), ranked over the batch."""
    w = Window.partitionBy(batch)
    return rows.where("k <= 1").withColumn("rrf", sum((1 / (F.lit(k) + F.row_number().over(w.orderBy(F.desc(c), "t", "eid", "k"))) for c in columns), F.lit(0.0)))


def fuse_in_pools(scored: DataFrame, columns: Sequence[str], k: int = 60) -> DataFrame:
    """A sample's fused score in each of its pools (eid, pool, place, target), averaged over the pools for the anchor (place 0): eid, rrf."""
    w = Window.partitionBy("eid", "pool")
    fused = scored.withColumn("rrf", sum((1 / (F.lit(k) + F.row_number().over(w.orderBy(F.desc(c), "place"))) for c in columns), F.lit(0.0)))
    return fused.where("place = 0").groupBy("eid").agg(F.avg("rrf").alias("rrf"))


def support_rows(rows: DataFrame, score: str, center: float, fraction: float) -> DataFrame:
    """``routed``: whether a row is among the share nearest to the center; ``diagnostic`` is its gap if so, else null."""
    near = rows.withColumn("_gap", F.abs(F.col(score) - center))
    chosen = first_rows(near, [F.col("_gap"), F.col("eid"), F.col("k")], budget(fraction, rows.count())).select("eid", "k", F.lit(True).alias("routed"))
    out = near.join(chosen, ["eid", "k"], "left").withColumn("routed", F.coalesce("routed", F.lit(False)))
    return out.withColumn("diagnostic", F.when(F.col("routed"), F.col("_gap"))).drop("_gap")


def out_of_fold(rows: DataFrame, features: Sequence[str], target: str, group: str, folds: int = 5, ridge: float = 1e-3) -> DataFrame:
    """``predicted``: a ridge fit of the other folds' rows; folds are drawn by group. The sums of each fold are aggregated once, a fold's
    fit is all sums less its own, and only they (folds x features^2 numbers) come to the driver."""
    import numpy as np

    fold = draw(F.col(group), F.lit(0), F.lit(folds)).cast("int")
    x = ["1", *features]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    n = len(x)
    placed = rows.withColumn("fold", fold)
    sums = placed.groupBy("fold").agg(*(F.sum(value(a) * value(b)).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j), *(F.sum(value(a) * F.col(target).cast("double")).alias(f"r{i}") for i, a in enumerate(x))).collect()
    gram = {r["fold"]: np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) for r in sums}
    right = {r["fold"]: np.array([r[f"r{i}"] for i in range(n)]) for r in sums}
    out = F.lit(None).cast("double")
    for f in gram:
        a = sum((g for k, g in gram.items() if k != f), np.zeros((n, n)))
        b = sum((v for k, v in right.items() if k != f), np.zeros(n))
        scale = np.sqrt(np.maximum(np.diag(a), 1e-12))
        w = np.linalg.solve(a / np.outer(scale, scale) + ridge * np.eye(n), b / scale) / scale
        out = F.when(F.col("fold") == f, sum((float(c) * value(name) for c, name in zip(w, x)), F.lit(0.0))).otherwise(out)
    return placed.withColumn("predicted", out)


def out_of_fold_views(rows: DataFrame, features: Sequence[str], call: Sequence[str], available: str, target: str, group: str, seeds: Sequence[int] = (0,), folds: int = 5, ridge: float = 1e-3) -> DataFrame:
    """``no_call`` and ``called``: predictions of ``target`` without and with the features of a ``call``, by ridge fits of the other folds' rows, meaned over the folds of
    each seed; folds are drawn by group. Fits see call features where ``available`` (else 0, as in the view without a call). The sums of all seeds and folds are one aggregate, and only they come to the
    driver (seeds x folds x features^2 numbers)."""
    import numpy as np

    x = ["1", *features, *call]
    plain = {c: F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in ["1", *features]}
    seen = plain | {c: F.when(F.col(available), F.col(c).cast("double")).otherwise(0.0) for c in call}
    fold = lambda seed: draw(F.col(group), F.lit(0), F.lit(folds), seed).cast("int")
    places = [f"_f{s}" for s in range(len(seeds))]
    placed = rows.withColumns({p: fold(s) for p, s in zip(places, seeds)})
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    # a row stands once for all seeds; what has the same folds is summed for each seed afterwards
    together = placed.groupBy(*places).agg(*(F.sum(seen[x[i]] * seen[x[j]]).alias(f"g{i}_{j}") for i, j in cells), *(F.sum(seen[c] * F.col(target).cast("double")).alias(f"r{i}") for i, c in enumerate(x)))
    spread = together.withColumn("_sf", F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.col(p).alias("fold")) for p, s in zip(places, seeds)))))
    sums = spread.groupBy("_sf").agg(*(F.sum(c).alias(c) for c in (*(f"g{i}_{j}" for i, j in cells), *(f"r{i}" for i in range(len(x)))))).collect()
    n = len(x)
    gram = {(r["_sf"]["seed"], r["_sf"]["fold"]): np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) for r in sums}
    right = {(r["_sf"]["seed"], r["_sf"]["fold"]): np.array([r[f"r{i}"] for i in range(n)]) for r in sums}
    views = {"no_call": plain | {c: F.lit(0.0) for c in call}, "called": plain | {c: F.col(c).cast("double") for c in call}}
    weights: list[list[Column]] = []
    for s, p in zip(seeds, places):
        all_gram, all_right = sum(g for k, g in gram.items() if k[0] == s), sum(r for k, r in right.items() if k[0] == s)
        fits = np.zeros((folds, n))
        for f in range(folds):
            if (s, f) in gram:
                a, b = all_gram - gram[s, f], all_right - right[s, f]
                scale = np.sqrt(np.maximum(np.diag(a), 1e-12))
                fits[f] = np.linalg.solve(a / np.outer(scale, scale) + ridge * np.eye(n), b / scale) / scale
        weights.append([F.get(F.array(*(F.lit(float(c)) for c in fits[:, i])), F.col(p)) for i in range(n)])
    value = lambda cols: sum((sum((w * cols[name] for w, name in zip(ws, x)), F.lit(0.0)) for ws in weights), F.lit(0.0)) / len(seeds)
    return placed.withColumns({v: value(cols) for v, cols in views.items()}).select(*rows.columns, *views)


def hyper_fusion(rows: DataFrame, columns: Sequence[str], batch: str, near: float = 0.1) -> DataFrame:
    """``fused``: the scorers' sum in each batch, each weighing as it agrees with the others. Two scorers are near if the cosine distance of their scores over the batch's positives
    (k = 0), or over its negatives, lies above 0 and below ``near``; a scorer with a near one is a member of that side, scorers share as many sides as both are members of, and a
    scorer's weight is 1 and its shares with all scorers, itself included. One aggregate over pairs of scorers."""
    m = len(columns)
    value = {c: F.col(c).cast("double") for c in columns}
    sides = (F.col("k") == 0, F.col("k") > 0)
    sums = rows.groupBy(batch).agg(*(F.sum(F.when(on, value[columns[i]] * value[columns[j]])).alias(f"_{s}_{i}_{j}") for s, on in enumerate(sides) for i in range(m) for j in range(i, m)))

    def distance(s: int, i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        norm = F.sqrt(F.col(f"_{s}_{i}_{i}") * F.col(f"_{s}_{j}_{j}"))
        return F.round(1 - F.when(norm > 0, F.col(f"_{s}_{i}_{j}") / norm).otherwise(0.0), 12)

    close = lambda s, i, j: (distance(s, i, j) > 0) & (distance(s, i, j) < near)
    member = [[F.greatest(*(F.coalesce(close(s, i, j), F.lit(False)).cast("int") for j in range(m) if j != i), F.lit(0)) for i in range(m)] for s in (0, 1)]
    flags = written(sums.select(batch, *(member[s][i].alias(f"_h_{s}_{i}") for s in (0, 1) for i in range(m))), "members")
    weight = lambda j: 1 + sum((F.col(f"_h_{s}_{i}") * F.col(f"_h_{s}_{j}") for s in (0, 1) for i in range(m)), F.lit(0))
    weights = flags.select(batch, *(weight(j).alias(f"_w_{j}") for j in range(m)))
    out = rows.join(weights, batch).withColumn("fused", sum((F.col(f"_w_{j}") * value[c] for j, c in enumerate(columns)), F.lit(0.0)))
    return out.drop(*(f"_w_{j}" for j in range(m)))
