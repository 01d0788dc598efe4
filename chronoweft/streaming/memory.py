"""Last messages and memories of nodes, as keyed state over a stream or as one aggregate over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoweft.operators.prefix import numbers_within
from chronoweft.sources.written import written

_OUT = "user_id long, ts timestamp, event_id long, value double, n long"
_STATE = "ts timestamp, event_id long, value double, n long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    n = int(last[3]) if last else 0
    best = (pd.Timestamp(last[0]), int(last[1]), float(last[2])) if last else None
    for b in batches:
        n += len(b)
        top = b.sort_values(["ts", "event_id"]).iloc[-1]
        found = (pd.Timestamp(top["ts"]), int(top["event_id"]), float(top["value"]))
        best = found if best is None or found[:2] > best[:2] else best  # late messages are counted and change nothing else
    if best is not None:
        state.update((best[0].to_pydatetime(), best[1], best[2], n))
        yield pd.DataFrame([(int(key[0]), *best, n)], columns=["user_id", "ts", "event_id", "value", "n"])


def last_messages(messages: DataFrame) -> DataFrame:
    """user_id, ts, event_id, value, n: the latest message (by ts, then id) of each node and the number so far; a stream gives a row for each node that a
    batch of messages changes (update mode)."""
    if messages.isStreaming:
        return messages.groupBy("user_id").applyInPandasWithState(_update, _OUT, _STATE, "update", "NoTimeout")
    top = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return messages.groupBy("user_id").agg(top, F.count("*").alias("n")).select("user_id", "m.ts", "m.event_id", "m.value", "n")


_BANK = "user_id long, memory double, updated timestamp, message double, at timestamp"


class MemoryState(StatefulProcessor):
    """A node's memory, and the last message that it has not taken in yet. A batch first lets the waiting message into the memory, then leaves its own last one waiting: what a
    batch brings is not known to that batch's own queries. Nodes without a message for ``idle_ms`` are forgotten when the watermark has passed that."""

    def __init__(self, rate: float, idle_ms: int | None):
        self.rate, self.idle = rate, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bank = handle.getValueState("bank", "memory double, updated timestamp, message double, at timestamp")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        time = lambda v: None if pd.isna(v) else pd.Timestamp(v).to_pydatetime()
        self.bank.update((float(r["memory"]), time(r["updated"]), None if pd.isna(r["message"]) else float(r["message"]), time(r["at"])))
        self._wait(time(r["at"]), timerValues)

    def _wait(self, at, timers) -> None:
        if self.idle is not None and at is not None:
            due = int(pd.Timestamp(at).value // 1_000_000) + self.idle
            self.handle.registerTimer(max(due, timers.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for b in rows:
            top = b.sort_values(["ts", "event_id"]).iloc[-1]
            found = (pd.Timestamp(top["ts"]), int(top["event_id"]), float(top["value"]))
            best = found if best is None or found[:2] > best[:2] else best
        memory, updated, message, at = self.bank.get() if self.bank.exists() else (0.0, None, None, None)
        if message is not None:
            memory, updated = (1 - self.rate) * memory + self.rate * message, at
        self.bank.update((memory, updated, best[2], best[0].to_pydatetime()))
        self._wait(best[0], timerValues)
        yield pd.DataFrame({"user_id": [int(key[0])], "memory": [memory], "updated": pd.Series([updated], dtype="datetime64[us]"), "message": [best[2]], "at": [best[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.bank.get() if self.bank.exists() else None
        if last is not None and int(pd.Timestamp(last[3]).value // 1_000_000) + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.bank.clear()
        yield pd.DataFrame(columns=["user_id", "memory", "updated", "message", "at"])

    def close(self) -> None:
        pass


def memory_bank(messages: DataFrame, rate: float = 0.5, idle_seconds: int | None = None, lateness: str = "1 hour", restored: DataFrame | None = None) -> DataFrame:
    """``_BANK`` of each node that a batch of messages (user_id, ts, event_id, value) changes: its memory, a mean of its messages that fades by ``rate``, when it last took one in, and
    the message that waits with its time.

    A stream keeps it as state, starts from ``restored`` (``_BANK``, as of ``backup``) if given, and forgets nodes idle for ``idle_seconds``. A table with a column ``batch`` gives the
    last state of each node; every batch counts with its last message."""
    if messages.isStreaming:
        keyed = messages.withWatermark("ts", lateness).groupBy("user_id")
        start = None if restored is None else restored.groupBy("user_id")
        return keyed.transformWithStateInPandas(MemoryState(rate, None if idle_seconds is None else idle_seconds * 1000), _BANK, "update", "EventTime", initialState=start)
    top = messages.groupBy("user_id", "batch").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    placed = written(numbers_within(top, ["user_id"], [F.col("batch")], "n"), "messages")
    last = placed.groupBy("user_id").agg(F.max("n").alias("all"))
    age = F.col("all") - 1 - F.col("n")
    part = F.when(age >= 0, rate * F.pow(F.lit(1 - rate), age.cast("double")) * F.col("m.value")).otherwise(0.0)
    pick = lambda c, k: F.max(F.when(age == k, F.col(c)))
    return placed.join(last, "user_id").groupBy("user_id").agg(F.sum(part).alias("memory"), pick("m.ts", 0).alias("updated"), pick("m.value", -1).alias("message"), pick("m.ts", -1).alias("at"))


def backup(spark: SparkSession, checkpoint: str, path: str) -> None:
    """The bank of a stream, as of its last committed batch, from its checkpoint to a table that ``memory_bank`` can start from."""
    state = spark.read.format("statestore").option("stateVarName", "bank").load(checkpoint)
    state.select("key.*", "value.*").select("user_id", "memory", "updated", "message", "at").write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BANK).parquet(path)
