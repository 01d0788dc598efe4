"""Interaction logs as DataFrames: edge lists, adjacency, query tables, text dimensions, vectors and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoweft.operators.prefix import row_numbers

EDGE_SCHEMA = "u long, r long, i long, ts double, label int"


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """An edge list with a header row: u, r, i, ts, label in any order, other columns left out; without a relation column the
    relation is 0. Raises on missing columns; a value that is no number fails the read."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    kinds = dict(c.strip().split() for c in EDGE_SCHEMA.split(","))
    if missing := [c for c in ("u", "i", "ts", "label") if c not in raw.columns]:
        raise ValueError(f"edge list without columns {missing}")
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(0)).cast(k).alias(c) for c, k in kinds.items()))


def rebase_labels(events: DataFrame) -> DataFrame:
    """Labels from 0 on: one less, unless the least is 0 already."""
    least = events.agg(F.min("label").alias("_least"))
    return events.join(F.broadcast(least)).withColumn("label", F.when(F.col("_least") != 0, F.col("label") - 1).otherwise(F.col("label"))).drop("_least")


def bucket_time(events: DataFrame, width: int = 15) -> DataFrame:
    return events.withColumn("ts", F.floor(F.col("ts") / width))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """An id and text table (i, text) from CSV; missing texts are empty."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("i long, text string").csv(path).withColumn("text", F.coalesce("text", F.lit("")))


def vector_problems(vectors: DataFrame, width: int) -> DataFrame:
    """Counts of what an embedding table (node, vector) must not have: repeated ids, gaps in the ids, vectors of another length than
    ``width``, zero rows, components that are no finite number; ``vectors`` is their number in all."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    per = vectors.groupBy("node").agg(F.count("*").alias("n"), F.first("vector").alias("v"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    return per.agg(
        F.sum("n").alias("vectors"), (F.sum("n") - F.count("*")).alias("repeated"), (F.max("node") - F.min("node") + 1 - F.count("*")).alias("gaps"),
        count(F.size("v") != width).alias("wrong_length"), count(~F.exists("v", lambda x: x != 0)).alias("zero"), count(F.exists("v", bad)).alias("not_finite"),
    )


def edges(spark: SparkSession, sf_dir: str, target: str = "l_partkey", shift: int = 0, nodes: int | None = None) -> DataFrame:
    """Order lines as events ``u`` (customer) to ``i`` (part) at day ``ts``. Customers and parts share one space of ids unless ``shift``
    moves the targets; ``nodes`` folds both ends into so many ids. ``eid`` keeps the input order: it counts the lines within the
    order, and leaves room for 65,536 of them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    fold = lambda c: F.col(c) if nodes is None else F.col(c) % nodes
    nth = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag)")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        fold("o_custkey").alias("u"), (fold(target) + shift).alias("i"), F.col("l_linenumber").cast("long").alias("r"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("ts"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_orderkey") * 65536 + nth).alias("eid"),
    )


def adjacency(events: DataFrame) -> DataFrame:
    """Every event at both ends, ``role`` out or in; a self-loop stands twice at its node."""
    end = lambda node, nbr, role: events.select(F.col(node).alias("node"), F.col(nbr).alias("nbr"), "ts", "r", "eid", F.lit(role).alias("role"))
    return end("u", "i", "out").unionByName(end("i", "u", "in"))


def first_contacts(events: DataFrame) -> DataFrame:
    """(node, nbr, first_ts) of the undirected log: known to each other at t exactly when first_ts < t."""
    return adjacency(events).groupBy("node", "nbr").agg(F.min("ts").alias("first_ts"))


def draw(of: Column, slot: Column, size: Column, seed: int = 0) -> Column:
    """A number from 0 below ``size`` for an id and a slot. A rule and no random stream, so that a lost task draws the same again;
    the square keeps the slots of an id from lying at one stride."""
    a = (F.pmod(of.cast("long"), F.lit(2147483647)) * 48271 + slot.cast("long") * 69621 + (12345 + seed)) % 2147483647
    return (a * a + a * 40692) % 2147483647 % size


def target_pool(events: DataFrame) -> DataFrame:
    """Distinct targets ``node`` with ``idx`` from 0 in their order."""
    return row_numbers(events.select(F.col("i").alias("node")).distinct(), [F.col("node")], "idx")


def queries(events: DataFrame, positives: DataFrame | None = None, negatives: int = 3) -> DataFrame:
    """Every event of ``positives`` (default: all) as a positive (k = 0) with drawn targets (k > 0) from the distinct targets of ``events``."""
    pool = target_pool(events)
    size = pool.agg(F.count("*").alias("_size"))
    asked = (events if positives is None else positives).select("eid", F.col("u").alias("src"), "i", F.col("ts").alias("t"))
    slots = asked.select("eid", "src", "t", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("k")).join(F.broadcast(size))
    drawn = slots.withColumn("idx", draw(F.col("eid"), F.col("k"), F.col("_size"))).join(pool, "idx").select("eid", "k", "src", F.col("node").alias("tgt"), "t")
    return asked.select("eid", F.lit(0).alias("k"), "src", F.col("i").alias("tgt"), "t").unionByName(drawn)


def validate(df: DataFrame, schema: str | StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` only, cast to their types; raises on a missing column."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if missing := [f.name for f in wanted if f.name not in df.columns]:
        raise ValueError(f"columns {missing} are missing")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted))
