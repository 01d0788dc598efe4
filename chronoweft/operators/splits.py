"""Leakage-safe splits, negative draws and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.prefix import quantiles, row_numbers
from chronoweft.sources.written import written


def boundaries(events: DataFrame, val: float = 0.15, test: float = 0.15) -> tuple[float, float]:
    """(val_time, test_time): linear quantiles of the times of all rows."""
    if not 0 <= val + test < 1:
        raise ValueError("the shares of validation and test must leave something to train on")
    low, high = quantiles(events, "ts", [1 - val - test, 1 - test])
    if low is None:
        raise ValueError("no events to split")
    return low, high


def chronological(events: DataFrame, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """``events`` with split: train up to val_time, val up to test_time, test after it."""
    val_time, test_time = boundaries(events, val, test)
    return events.withColumn("split", F.when(F.col("ts") <= val_time, "train").when(F.col("ts") <= test_time, "val").otherwise("test"))


def endpoints(events: DataFrame) -> DataFrame:
    return events.select(F.col("u").alias("node")).union(events.select(F.col("i").alias("node"))).distinct()


def reserve_nodes(split: DataFrame, share: float = 0.1) -> DataFrame:
    """int(share * nodes) nodes among those seen after val_time, those of the least (node * 7919) % 10007."""
    n = F.floor(F.count("*") * share)
    late = endpoints(split.where("split <> 'train'")).withColumn("h", F.col("node") * 7919 % 10007)
    # candidates are ranked within their h, after the counts of the 10,007 values of h before it
    quota = endpoints(split).agg(n.alias("quota"))
    by_hash = late.groupBy("h").agg(F.count("*").alias("c")).select("h", (F.sum("c").over(Window.orderBy("h")) - F.col("c")).alias("before"))
    ranked = late.join(by_hash, "h").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("h").orderBy("node")))
    return ranked.join(F.broadcast(quota)).where("rank <= quota").select("node")


def inductive(split: DataFrame, reserved: DataFrame) -> DataFrame:
    """``split`` with observed (a train event without a reserved end) and is_new (an end outside observed train). Give written tables."""
    flag = reserved.select("node", F.lit(1).alias("hit"))
    out = split
    for c in ("u", "i"):
        out = out.join(flag.withColumnsRenamed({"node": c, "hit": f"held_{c}"}), c, "left")
    out = written(out.withColumn("observed", (F.col("split") == "train") & F.col("held_u").isNull() & F.col("held_i").isNull()), "observed")
    known = written(endpoints(out.where("observed")).withColumn("hit", F.lit(1)), "known")
    for c in ("u", "i"):
        out = out.join(known.withColumnsRenamed({"node": c, "hit": f"known_{c}"}), c, "left")
    return out.withColumn("is_new", F.col("known_u").isNull() | F.col("known_i").isNull()).drop("held_u", "held_i", "known_u", "known_i")


def first_touch(events: DataFrame) -> DataFrame:
    """``eid`` with first_touch: whether either end has no earlier event, in either role."""
    ends = events.select("eid", "ts", F.explode(F.array("u", "i")).alias("node"))
    first = ends.groupBy("node").agg(F.min("ts").alias("first_ts"))
    return ends.join(first, "node").groupBy("eid").agg(F.max((F.col("ts") == F.col("first_ts")).cast("int")).alias("first_touch"))


def pair_pool(events: DataFrame) -> DataFrame:
    """Distinct (u, i, ts) with their number of rows; the row of the least eid stands for them."""
    return events.groupBy("u", "i", "ts").agg(F.count("*").alias("multiplicity"), F.min("eid").alias("eid"))


def historical_candidates(events: DataFrame, start: float, end: float, observed_until: float | None = None) -> DataFrame:
    """Pairs first seen before ``start`` and absent from [start, end]; with ``observed_until``, pairs seen up to
    then are left out too (inductive negatives)."""
    pairs = events.groupBy("u", "i").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    batch = events.where(F.col("ts").between(start, end)).select("u", "i").distinct()
    out = pairs.where(F.col("first_ts") < start).join(batch, ["u", "i"], "left_anti")
    return out if observed_until is None else out.where(F.col("first_ts") > observed_until)


def leakage(history: DataFrame, q: DataFrame) -> DataFrame:
    """Number of history rows (eid, k, ts) that are not strictly before their query's t; 0 if all is well."""
    return history.join(q, ["eid", "k"]).agg(F.coalesce(F.sum((F.col("ts") >= F.col("t")).cast("long")), F.lit(0)).alias("violations"), F.count("*").alias("checked"))


def recency_cutoff(events: DataFrame, since: float, share: float | None = None) -> DataFrame:
    """Events at or after ``since``; with ``share``, of those the latest int(share * n) by (ts, eid)."""
    out = events.where(F.col("ts") >= since)
    if share is None:
        return out
    ranked = row_numbers(out, [F.desc("ts"), F.desc("eid")], "_place")
    keep = int(share * ranked.count())
    return ranked.where(F.col("_place") < keep).drop("_place")
