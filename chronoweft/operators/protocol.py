"""Leakage-safe training protocol: provenance, masks, pools, scopes, validators, and joins that must be one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.operators.prefix import row_numbers
from chronoweft.operators.splits import boundaries, inductive, reserve_nodes
from chronoweft.sources.written import written

TRAINING = "observed_train"
IDENTITY = ("query_id", "source_id", "target_id", "timestamp", "label")


def graph_history(events: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Events strictly before ``cutoff`` (all without one)."""
    return events if cutoff is None else events.where(F.col("ts") < cutoff)


def edge_classification(split: DataFrame) -> DataFrame:
    """Split events whose class, the label, takes the relation's place."""
    return split.withColumn("r", F.col("label").cast("long"))


def training_protocol(events: DataFrame, val: float = 0.15, test: float = 0.15, share: float = 0.1) -> DataFrame:
    """``events`` with split, observed (may be trained on and be history in training) and is_new. Raises on missing values and on
    negative ids, which no history can hold."""
    bad = events.where("u is null or i is null or ts is null or isnan(double(ts)) or abs(double(ts)) = double('infinity') or u < 0 or i < 0").limit(1).count()
    if bad:
        raise ValueError("ids must be whole numbers from 0 on and times finite")
    low, high = boundaries(events, val, test)
    split = written(events.withColumn("split", F.when(F.col("ts") <= low, "train").when(F.col("ts") <= high, "val").otherwise("test")), "split")
    return inductive(split, written(reserve_nodes(split, share), "reserved"))


def protocol_history(protocol: DataFrame) -> DataFrame:
    """The events that training may see as history, tagged with their scope."""
    return protocol.where("observed").withColumn("scope", F.lit(TRAINING))


def require_scope(rows: DataFrame, scope: str = TRAINING) -> DataFrame:
    """``rows`` if they all have this one ``scope``; raises otherwise, also without the column."""
    if "scope" not in rows.columns:
        raise ValueError("rows do not say which history they were made with")
    if rows.where(~F.col("scope").eqNullSafe(F.lit(scope))).limit(1).count():
        raise ValueError(f"rows were made with another history than {scope!r}")
    return rows


def violations(protocol: DataFrame, q: DataFrame, history: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row with the numbers of what a training set must not have: history events (eid, k, node, nbr, ts) at or after their query's
    time, history ends and query ends (src, tgt) outside the observed nodes, negatives (tgt) outside the observed targets."""
    observed = protocol.where("observed")
    nodes = observed.select(F.col("u").alias("node")).union(observed.select("i")).distinct()
    targets = observed.select(F.col("i").alias("node")).distinct()
    outside = lambda df, c, pool: df.join(pool.withColumnRenamed("node", c), c, "left_anti").agg(F.count("*").alias("n"))
    ends = q.select(F.explode(F.array("src", "tgt")).alias("node"))
    parts = {
        "late_history": history.join(q.select("eid", "k", "t"), ["eid", "k"]).where("ts >= t").agg(F.count("*").alias("n")),
        "unobserved_history": outside(history.select(F.explode(F.array("node", "nbr")).alias("node")), "node", nodes),
        "unobserved_ends": outside(ends, "node", nodes), "foreign_negatives": outside(negatives.select("tgt"), "tgt", targets),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def require_clean(found: DataFrame) -> None:
    """Raises if any rule of ``violations`` is broken."""
    broken = [f"{r['rule']}: {r['n']}" for r in found.where("n > 0").collect()]
    if broken:
        raise ValueError("leakage: " + ", ".join(broken))


def eval_edges(events: DataFrame, val_time: float, test_time: float, closed: str = "right") -> DataFrame:
    """Validation events between the boundaries; ``closed``: right is (val, test], as in the split, left is [val, test)."""
    if closed not in ("left", "right"):
        raise ValueError("closed is left or right")
    ts = F.col("ts")
    return events.where((ts > val_time) & (ts <= test_time) if closed == "right" else (ts >= val_time) & (ts < test_time))


def identity_join(left: DataFrame, right: DataFrame, on: Sequence[str] = IDENTITY) -> DataFrame:
    """Rows of two tables with the same identity, one to one; raises if an identity is repeated or stands on one side only."""
    count = lambda df, n: df.groupBy(*on).agg(F.count("*").alias(n))
    both = count(left, "_l").join(count(right, "_r"), list(on), "full_outer")
    bad = both.agg(
        F.sum((F.coalesce("_l", F.lit(0)) == 0).cast("long")).alias("outside"), F.sum((F.coalesce("_r", F.lit(0)) == 0).cast("long")).alias("missing"),
        F.sum(((F.coalesce("_l", F.lit(0)) > 1) | (F.coalesce("_r", F.lit(0)) > 1)).cast("long")).alias("repeated"),
    ).first()
    if any(bad):
        raise ValueError(f"identities are not one to one: {bad.asDict()}")
    return left.join(right, list(on))


def fingerprint(events: DataFrame, columns: Sequence[str], order: Sequence[str], block: int = 4096) -> str:
    """A digest of a table's values in their order: SHA-256 of the digests of consecutive blocks of rows, so that no task or driver holds
    the rows; one line for each block comes back."""
    import hashlib

    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)), 256)
    numbered = row_numbers(events.select(*columns, *(c for c in order if c not in columns)), [F.col(c) for c in order], "_n")
    blocks = numbered.select(F.floor(F.col("_n") / block).alias("b"), "_n", row.alias("d")).groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    digest = hashlib.sha256()
    for r in blocks.orderBy("b").toLocalIterator():
        digest.update(r["d"].encode())
    return digest.hexdigest()
