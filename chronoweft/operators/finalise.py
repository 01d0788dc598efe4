"""Samples finished for prompts and routing in one flow: scores, their fusion, calibrated signals, expert labels and buckets; and the evaluation of a hybrid policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.operators import ranking as R
from chronoweft.operators import registry
from chronoweft.operators import routing as G
from chronoweft.operators.asof import asof_attach
from chronoweft.operators.calibration import Signal, contextual_calibration, earlier_shares, sequential_calibration
from chronoweft.operators.collaborative import add_pair_stats
from chronoweft.operators.prefix import first_rows
from chronoweft.operators.sampling import training_pools
from chronoweft.operators.scorers import KEY
from chronoweft.sources.tables import adjacency
from chronoweft.sources.written import written

#: Signals that prompts show; a calibration takes those of its reference.
PROMPT_SIGNALS = [
    Signal("source_popularity", pool="popularity"), Signal("target_popularity", pool="popularity"), Signal("past"),
    Signal("recency", False, "No prior interactions"), Signal("global_recency", True, "No prior target interactions"),
]


def sequential_fusion(rows: DataFrame, columns: Sequence[str], bins: int = 1024, k: int = 60) -> DataFrame:
    """``rows`` with ``<scorer>_rank``, a pseudo-rank from 1 to ``bins`` by the share of earlier scores (those at smaller t) up to the row's own, and ``rrf``, the
    sum of 1 / (k + rank). Every scorer may be of any real values; before there are earlier ones the rank is the middle one."""
    out, shares = rows, written(earlier_shares(rows, columns), "shares")
    for c in columns:
        share = shares.where(F.col("name") == c).select(F.col("t").alias("_t"), F.col("v").alias(f"_{c}"), F.col("share").alias("_share"))
        rank = F.coalesce(F.floor((1 - F.col("_share")) * (bins - 1) + 0.5) + 1, F.lit((bins + 1) // 2))
        out = out.withColumns({f"_{c}": F.col(c).cast("double"), "_t": F.col("t").cast("double")}).join(share, ["_t", f"_{c}"], "left")
        out = out.withColumn(f"{c}_rank", rank).drop("_t", f"_{c}", "_share")
    return out.withColumn("rrf", sum((1 / (F.lit(k) + F.col(f"{c}_rank")) for c in columns), F.lit(0.0)))


def pool_fusion(events: DataFrame, q: DataFrame, columns: Sequence[str], pools: int, size: int, k: int = 60) -> DataFrame:
    """eid, k, rrf: the fused score of each query's target among ``size`` - 1 drawn entities, by ranks within each of ``pools`` pools, averaged over the pools."""
    # a sample's pools are drawn by its own number: that of the query and its slot
    samples = q.withColumnsRenamed({"eid": "_eid", "k": "_k"}).withColumn("eid", F.col("_eid") * 4096 + F.col("_k"))
    drawn = written(training_pools(samples.select("eid", "src", "tgt", "t"), events.select(F.col("i").alias("node")), pools, size), "pools")
    asked = drawn.select((F.col("eid") * pools + F.col("pool")).alias("eid"), F.col("place").alias("k"), "src", F.col("target").alias("tgt"), "t")
    scored = registry.scores(events, written(asked, "pool-queries"), columns)
    scored = scored.select(F.floor(F.col("eid") / pools).alias("eid"), (F.col("eid") % pools).alias("pool"), F.col("k").alias("place"), *columns)
    return G.fuse_in_pools(scored, columns, k).select(F.floor(F.col("eid") / 4096).alias("eid"), (F.col("eid") % 4096).cast("int").alias("k"), "rrf")


def structural_bucket(score: Column, low: float, high: float) -> Column:
    """Low below ``low``, High from ``high`` on, else Modest; Unknown without a score."""
    return F.when(score.isNull(), "Unknown").when(score < low, "Low").when(score >= high, "High").otherwise("Modest")


def finalise_samples(
    events: DataFrame, q: DataFrame, columns: Sequence[str] = ("recency", "popularity", "past", "ra"), mode: str = "query_local", reference: str = "sequential", expert: str = "running",
    fixed_threshold: float = 0.05, low: float = 0.0475, high: float = 0.0510, bins: int = 1024, pools: int = 4, pool_size: int = 256, k: int = 60,
) -> DataFrame:
    """``q`` with its scores, ``rrf`` and ``rrf_rank``, the levels and percentiles of its signals, ``expert`` and ``structural``.

    ``mode``: ranks within the query (``query_local``), among all earlier scores (``sequential``), or in drawn pools (``train_pool``). ``reference``: signals are placed among those of earlier samples
    (``sequential``) or among active entities and the source's counterparts (``contextual``). ``expert``: Yes or No by the fused score against the median of all (``global``), of earlier ones (``running``, Unknown
    before there are any) or ``fixed_threshold`` (``fixed``). ``structural``: the fused score's bucket between ``low`` and ``high``."""
    q = written(q, "samples")
    known = [*dict.fromkeys([*columns, "popularity", "global_recency"])]
    rows = registry.scores(events, q, known).withColumns({c: F.round(c, 9) for c in ("aa", "ra", "markov", "item_cf", "user_cf", "ppr") if c in known})
    rows = written(rows, "sample-scores")
    if mode == "query_local":
        fused = R.reciprocal_rank_fusion(rows, columns, k=k)
    elif mode == "sequential":
        fused = sequential_fusion(rows, columns, bins, k)
    elif mode == "train_pool":
        fused = rows.join(pool_fusion(events, q, columns, pools, pool_size, k), KEY)
    else:
        raise ValueError("mode is query_local, sequential or train_pool")
    fused = written(fused.withColumn("rrf", F.round("rrf", 9)), "sample-fusion").withColumn("rrf_rank", R.descending_rank("rrf", ["eid"]))
    seen = lambda c: F.when(F.col(c) > -1e14, F.col(c))
    base = asof_attach(adjacency(events).select("node", "ts"), fused.select(*q.columns, "popularity", "global_recency"), {"src": "node"}, {"source_popularity": ("count", F.col("ts"))}, counted=q)
    base = add_pair_stats(events, q, base).select(
        *q.columns, "source_popularity", F.col("popularity").alias("target_popularity"), F.col("directed").alias("past"), (F.col("t") - F.col("last_ts")).alias("recency"), seen("global_recency").alias("global_recency"))
    base = written(base, "sample-signals")
    if reference == "sequential":
        placed = sequential_calibration(base, PROMPT_SIGNALS)
    elif reference == "contextual":
        placed = contextual_calibration(events, base)
    else:
        raise ValueError("reference is sequential or contextual")
    levels = [f"{s.name}_{c}" for s in PROMPT_SIGNALS for c in ("level", "pct")]
    out = G.expert_labels(fused, "rrf", expert, fixed_threshold if expert == "fixed" else None).withColumn("structural", structural_bucket(F.col("rrf"), low, high))
    return out.join(placed.select(*KEY, *levels), KEY)


def learned_top(rows: DataFrame, priorities: DataFrame, fraction: float, score: str | None = None, center: float | None = None, weight: float = 0.0, default: float | None = None) -> DataFrame:
    """The share of the rows with the largest learned priority (eid, k, priority), with it as ``priority``; ties by eid, k.

    Rows without one get ``default``, or are an error. With ``weight``, the priority's z-score counts 1 - weight and that of minus the distance of ``score`` from ``center`` counts ``weight``; means and deviations
    (of the population) are those of the rows."""
    joined = written(rows.join(priorities.select(*KEY, F.col("priority").cast("double").alias("priority")), KEY, "left").withColumn("priority", F.coalesce("priority", F.lit(default).cast("double"))), "priorities")
    if joined.where("priority is null or isnan(priority)").limit(1).count():
        raise ValueError("rows without a priority")
    if weight:
        joined = joined.withColumn("_near", -F.abs(F.col(score).cast("double") - center))
        m = joined.agg(F.avg("priority"), F.greatest(F.stddev_pop("priority"), F.lit(1e-12)), F.avg("_near"), F.greatest(F.stddev_pop("_near"), F.lit(1e-12))).first()
        if m[0] is not None:
            joined = joined.withColumn("priority", (1 - weight) * (F.col("priority") - m[0]) / m[1] + weight * (F.col("_near") - m[2]) / m[3])
        joined = joined.drop("_near")
    return first_rows(joined, [F.desc("priority"), F.col("eid"), F.col("k")], G.budget(fraction, joined.count()))


def hybrid_evaluation(rows: DataFrame, base: str, other: str, selected: DataFrame, method: str = "rank_graft", alpha: float = 1.0, by: Sequence[str] = ("batch",), label: str = "label") -> DataFrame:
    """One row: AUC and AP of the base scores and of the hybrid ones on all rows, the changes, the share of rows that were ``selected`` (eid, k), and the mean change of their scores.

    Selected rows take the other score: their base scores dealt out anew in its order within each of ``by`` (``rank_graft``), ``alpha`` parts of it (``alpha``), or it alone (``replace``). Scores are scaled to [0, 1] by all rows first."""
    flags = selected.select(*KEY, F.lit(True).alias("_in"))
    scaled = G.minmax_scores(rows, base, "_base")
    scaled = written(scaled.join(flags, KEY, "left").withColumn("_in", F.coalesce("_in", F.lit(False))), "hybrid-rows")
    inside = scaled.where("_in")
    if method == "rank_graft":
        merged = G.rank_graft(inside, "_base", other, "_hybrid", [*by])
    elif method in ("alpha", "replace"):
        merged = G.merge(inside, "_base", other, alpha if method == "alpha" else 1.0, "_hybrid")
    else:
        raise ValueError("method is rank_graft, alpha or replace")
    both = written(merged.unionByName(scaled.where("not _in").withColumn("_hybrid", F.col("_base"))), "hybrid-scores")
    change = G.policy_change(both, "_base", "_hybrid", label)
    share = both.agg(F.avg(F.col("_in").cast("double")).alias("selected_share"), F.avg(F.when(F.col("_in"), F.abs(F.col("_hybrid") - F.col("_base")))).alias("mean_change"))
    return change.join(share)  # one row each
