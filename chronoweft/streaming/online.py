"""Scoring a stream of events and queries against what was committed before: prepare, score, commit, each micro-batch once.

State is two tables a version, written to a folder that all machines share: the events of the last ``window`` and the queries that wait. Batch n reads
version n - 1 and writes version n, so a batch that comes again gives the same rows and changes nothing, and an earlier one that comes again (a new run from there) takes the state
back to what it was: what later batches had committed is dropped. Events may arrive late by ``lateness``: a query waits until no earlier event can
arrive. State holds a window of events, never the whole past.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "u long, i long, ts long, r long, eid long, label int"
QUERIES = "eid long, k int, src long, tgt long, t long"


def mixed(events: DataFrame, q: DataFrame) -> DataFrame:
    """Events and queries as rows of one stream: ``kind`` event or query."""
    both = [f.split() for f in f"{EVENTS}, {QUERIES}".split(", ")]
    kinds = dict(both)
    out = []
    for rows, kind in ((events, "event"), (q, "query")):
        out.append(rows.select(F.lit(kind).alias("kind"), *((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds)))
    return out[0].unionByName(out[1])


class OnlineScorer:
    """Give ``process`` to ``foreachBatch``. ``score``: a plan of (events, queries) that looks back ``window`` at most and returns eid, k and its columns."""

    def __init__(self, spark: SparkSession, folder: str, score: Callable[[DataFrame, DataFrame], DataFrame], window: float, lateness: float = 0):
        self.spark, self.folder, self.score, self.window, self.lateness = spark, folder.rstrip("/"), score, window, lateness

    def _path(self, what: str, version: int) -> str:
        return f"{self.folder}/{what}/v{version:09d}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _read(self, what: str, version: int, schema: str) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], schema)
        if not self._exists(self._path(what, version)):
            raise ValueError(f"batch {version + 1} comes without the state of batch {version}")
        return self.spark.read.schema(schema).parquet(self._path(what, version))

    def prepare(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(events known with this batch, queries that can be answered, queries that wait)."""
        columns = lambda s: [c.split()[0] for c in s.split(", ")]
        events = self._read("events", batch_id - 1, EVENTS).unionByName(batch.where("kind = 'event'").select(*columns(EVENTS)))
        waiting = self._read("queries", batch_id - 1, QUERIES).unionByName(batch.where("kind = 'query'").select(*columns(QUERIES)))
        newest = events.agg(F.max("ts")).first()[0]
        # the newest time may still grow: queries at it see no event of it, those after it wait
        ripe = F.lit(newest is not None) & (F.col("t") <= F.lit(newest) - self.lateness)
        return events, waiting.where(ripe), waiting.where(~ripe)

    def commit(self, events: DataFrame, waiting: DataFrame, batch_id: int) -> None:
        newest = events.agg(F.max("ts")).first()[0]
        oldest = waiting.agg(F.min("t")).first()[0]
        if newest is not None:  # a late query may be as old as the oldest that waits, or the lateness
            floor = min(newest - self.lateness, newest if oldest is None else oldest) - self.window
            events = events.where(F.col("ts") >= floor)
        events.write.mode("overwrite").parquet(self._path("events", batch_id))
        waiting.write.mode("overwrite").parquet(self._path("queries", batch_id))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Scores of the batch's answerable queries as ``results/v<batch>``, then the next state. The results come first: a batch lost in between is done again whole."""
        later = batch_id
        if self._exists(self._path("events", batch_id + 1)):  # another run from here on
            while self._exists(self._path("events", later)):
                for what in ("queries", "events", "results"):
                    self._delete(self._path(what, later))
                later += 1
        if self._exists(self._path("queries", batch_id)):
            return
        batch = batch.persist()
        try:
            events, ripe, waiting = self.prepare(batch, batch_id)
            scored = self.score(events, ripe)
            scored.write.mode("overwrite").parquet(self._path("results", batch_id))
            self.commit(events, waiting, batch_id)
        finally:
            batch.unpersist()

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results/*")
