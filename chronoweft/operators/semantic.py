"""Vector scorers over an id-keyed table (node, vector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def similarity(q: DataFrame, vectors: DataFrame) -> DataFrame:
    """eid, k, similarity: product of the unit vectors of source and target, 0 if one has none."""
    unit = vectors.select("node", normalise(F.col("vector").cast("array<double>")).alias("v"))
    out = q.join(unit.withColumnsRenamed({"node": "src", "v": "a"}), "src", "left").join(unit.withColumnsRenamed({"node": "tgt", "v": "b"}), "tgt", "left")
    return out.select("eid", "k", F.coalesce(dot("a", "b"), F.lit(0.0)).alias("similarity"))


def hadamard(q: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``features``: product by component of the vectors of source and target; zeros if one has none."""
    v = vectors.select("node", F.col("vector").cast("array<double>").alias("v"))
    out = q.join(v.withColumnsRenamed({"node": "src", "v": "a"}), "src", "left").join(v.withColumnsRenamed({"node": "tgt", "v": "b"}), "tgt", "left")
    return out.select("eid", "k", F.coalesce(F.zip_with("a", "b", lambda x, y: x * y), F.array_repeat(F.lit(0.0), width)).alias("features"))


def history_mean(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """node, mean: event-weighted mean of the vectors of a source's destinations, summed by dimension."""
    counts = events.groupBy("u", "i").agg(F.count("*").alias("n"))
    parts = counts.join(vectors.withColumnRenamed("node", "i"), "i").select("u", "n", F.posexplode(F.col("vector").cast("array<double>")))
    mean = parts.groupBy("u", "pos").agg((F.sum(F.col("col") * F.col("n")) / F.sum("n")).alias("x"))
    return mean.select(F.col("u").alias("node"), F.col("pos").alias("dim"), "x")


def initialised_sources(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """node, v: the scaled mean of the vectors of a source's destinations in place of its own, events counting, where both ends have a vector; other nodes keep theirs."""
    own = vectors.select("node", F.col("vector").cast("array<double>").alias("own"))
    known = events.join(own.select(F.col("node").alias("u")), "u", "left_semi")
    mean = history_mean(known, vectors).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    return own.join(mean.select("node", normalise(F.col("v")).alias("v")), "node", "left").select("node", F.coalesce("v", "own").alias("v"))


def smooth(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """One step of symmetric-normalised smoothing with self-loops: node, dim, x of D^-1/2 (A + I) D^-1/2 X."""
    both = events.select("u", "i").union(events.select(F.col("i").alias("u"), F.col("u").alias("i")))
    weights = both.groupBy("u", "i").agg(F.count("*").cast("double").alias("w"))
    loops = vectors.select(F.col("node").alias("u"), F.col("node").alias("i"), F.lit(1.0).alias("w"))
    a = weights.join(vectors.select(F.col("node").alias("i")), "i", "left_semi").join(vectors.select(F.col("node").alias("u")), "u", "left_semi").select("u", "i", "w").union(loops).groupBy("u", "i").agg(F.sum("w").alias("w"))
    degree = a.groupBy("u").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("d"))
    scaled = a.join(degree, "u").join(degree.withColumnsRenamed({"u": "i", "d": "di"}), "i").select("u", "i", (F.col("w") / F.sqrt(F.col("d") * F.col("di"))).alias("w"))
    parts = scaled.join(vectors.withColumnRenamed("node", "i"), "i").select("u", "w", F.posexplode(F.col("vector").cast("array<double>")))
    return parts.groupBy(F.col("u").alias("node"), F.col("pos").alias("dim")).agg(F.sum(F.col("w") * F.col("col")).alias("x"))
