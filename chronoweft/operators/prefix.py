"""Numbers, running totals and quantiles over a whole table without one task that sees it all.

Rows are dealt out by ranges of the order and written; a number or total within a range plus those of the ranges before it, one row
for each range, gives the global one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import asof
from chronoweft.sources.written import written


def _ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with columns named by ``sums``: totals of the columns it names, over the rows up to this one. Rows must differ in ``order``."""
    parts = _ranges(df, order)
    totals = parts.groupBy("_range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("_range", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select(*df.columns, "_range", *(F.sum(c).over(here).alias(n) for n, c in sums.items()))
    return out.join(F.broadcast(offsets), "_range").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place in ``order``, from 0."""
    out = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"})
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, by their numbers: no task gathers them all, whatever share of the table they are."""
    return row_numbers(df, order, "_place").where(F.col("_place") < n).drop("_place")


def totals_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """As ``running_totals``, but within each value of ``keys``. Where a hash of keys holds more than ``asof.ROWS`` rows, a key's rows lie in as many ranges as they need: the totals over all
    rows in the order of (keys, order) less those before the key's first row; otherwise rows are dealt out by key, once. Keys must not be null."""
    if not asof.crowded(df, keys):
        here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *(F.sum(c).over(here).alias(n) for n, c in sums.items()))
    out = running_totals(df, [*map(F.col, keys), *order], sums)
    start = out.groupBy(*keys).agg(*(F.min(F.col(n) - F.col(c)).alias(f"_{n}") for n, c in sums.items()))
    return out.join(start, list(keys)).select(*df.columns, *((F.col(n) - F.col(f"_{n}")).alias(n) for n in sums))


def numbers_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place, from 1, among the rows of its ``keys``."""
    return totals_within(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {name: "_one"}).drop("_one")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    """``df`` with columns of the row before in the same ``keys`` (name: column; null for the first), met by its number
    where keys are crowded."""
    if not asof.crowded(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *(F.lag(c).over(w).alias(n) for n, c in columns.items()))
    placed = written(numbers_within(df, keys, order, "_n"), "numbered")
    before = placed.select(*keys, (F.col("_n") + 1).alias("_n"), *(F.col(c).alias(n) for n, c in columns.items()))
    return placed.join(before, [*keys, "_n"], "left").select(*df.columns, *columns)


def batches(df: DataFrame, order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Consecutive rows in groups of ``size``; the last group may be smaller."""
    return row_numbers(df, order, name).withColumn(name, F.floor(F.col(name) / size))


def quantiles(df: DataFrame, column: str, levels: Sequence[float]) -> list[float | None]:
    """Linear quantiles of a column's values that are not null, exactly: values are counted first, and only the rows around the asked places come back."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = running_totals(counts, [F.col("v")], {"upto": "c"})
    n = upto.agg(F.max("upto")).first()[0]
    if not n:
        return [None] * len(levels)
    spots = sorted({k for p in levels for k in (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1))})
    asked = df.sparkSession.createDataFrame([(k,) for k in spots], "k long")
    at = {r["k"]: r["v"] for r in upto.join(F.broadcast(asked), (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c"))).select("k", "v").collect()}
    out = []
    for p in levels:
        place = (n - 1) * p
        low = int(place)
        a, b = at[low], at[min(n - 1, low + 1)]
        out.append(a + (b - a) * (place - low))
    return out
