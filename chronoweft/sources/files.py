"""Prompt sets, debug rows and result documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_prompts(rows: DataFrame, path: str) -> None:
    """``rows`` (prompt and further columns) as JSON lines, each with the digest of its prompt."""
    rows.withColumn("prompt_sha256", F.sha2("prompt", 256)).write.json(path)


def read_prompts(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Prompt rows: ``fields``, prompt, prompt_sha256. Raises where a field is missing or a prompt is not what its digest says."""
    rows = spark.read.schema(f"{fields}, prompt string, prompt_sha256 string").json(path)
    missing = F.lit(False)
    for c in rows.columns:
        missing = missing | F.col(c).isNull()
    bad = rows.agg(F.count_if(missing).alias("missing"), F.count_if(F.sha2("prompt", 256) != F.col("prompt_sha256")).alias("changed")).first()
    if any(bad):
        raise ValueError(f"prompts are not as written: {bad.asDict()}")
    return rows


def append_debug_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_result(spark: SparkSession, result: dict, path: str) -> None:
    """One JSON document."""
    import json

    spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def summarise(results: DataFrame, metrics: list[str], by: str = "setting", run: str = "seed") -> DataFrame:
    """Mean and sample deviation of each metric over the runs of a setting. Raises where a run is repeated or settings have other runs."""
    if results.groupBy(by, run).count().where("count > 1").limit(1).count():
        raise ValueError("a run stands twice")
    runs = results.groupBy(by).agg(F.array_sort(F.collect_set(run)).alias("runs"))
    if runs.select("runs").distinct().count() > 1:
        raise ValueError("settings have different runs")
    return results.groupBy(by).agg(*(f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
