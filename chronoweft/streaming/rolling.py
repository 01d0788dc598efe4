"""The neighbours of a node in the window before a query's time, as keyed state with timers over a stream that arrives out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "node long, ask long, t timestamp, nbr long, n long"


class WindowState(StatefulProcessor):
    """Of each node the counts of its window's events by (time, neighbour), and the queries that wait. A query's timer goes off when the watermark has passed its time, as no
    earlier event can come any more; it gives a row for each neighbour in [t - window, t), or one of none (nbr null). Events that no later query
    can ask for are forgotten at the next timer, and a node without any is forgotten whole."""

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "ms long, nbr long", "n long")
        self.asks = handle.getMapState("asks", "ms long, ask long", "one int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late, keep = timerValues.getCurrentWatermarkInMs(), False
        for b in rows:
            ms = b["ts"].astype("datetime64[ms]").astype("int64")
            for (at, nbr), n in pd.Series(1, index=[ms[b["ask"].isna()], b["nbr"][b["ask"].isna()]]).groupby(level=[0, 1]).sum().items():
                k = (int(at), int(nbr))
                self.events.updateValue(k, ((self.events.getValue(k) or (0,))[0] + int(n),))
                keep = max(keep or 0, int(at))
            for at, ask in zip(ms[b["ask"].notna()], b["ask"][b["ask"].notna()]):
                self.asks.updateValue((int(at), int(ask)), (1,))
                self.handle.registerTimer(max(int(at), late + 1))
        if keep is not False:  # nothing of it can be asked for after this
            self.handle.registerTimer(max(keep + self.window + 1, late + 1))
        yield pd.DataFrame(columns=["node", "ask", "t", "nbr", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        late, node, out = timerValues.getCurrentWatermarkInMs(), int(key[0]), []
        held = [(int(k[0]), int(k[1]), int(v[0])) for k, v in self.events.iterator()]
        for at, ask in sorted((int(k[0]), int(k[1])) for k in self.asks.keys()):
            if at > late:
                continue
            found: dict[int, int] = {}
            for ms, nbr, n in held:
                if at - self.window <= ms < at:
                    found[nbr] = found.get(nbr, 0) + n
            out += [(node, ask, pd.Timestamp(at, unit="ms"), nbr, n) for nbr, n in found.items()] or [(node, ask, pd.Timestamp(at, unit="ms"), None, 0)]
            self.asks.removeKey((at, ask))
        for ms, nbr, _ in held:
            if ms < late - self.window:
                self.events.removeKey((ms, nbr))
        frame = pd.DataFrame(out, columns=["node", "ask", "t", "nbr", "n"])
        yield frame.astype({"nbr": "Int64"})

    def close(self) -> None:
        pass


def rolling_neighbors(rows: DataFrame, window_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """node, ask, t, nbr, n: for each query the neighbours of its node in [t - window, t) with their events; one row of none (null, 0) without any.

    ``rows``: node, ts, nbr and ask; ``ask`` is null for an event and the query's number for a query at ts. A stream answers a query once the
    watermark (``lateness`` behind the newest row) has passed it, whatever the order of arrival; rows later than that are dropped. A table is answered by one plan."""
    if rows.isStreaming:
        keyed = rows.select("node", "ts", "nbr", "ask").withWatermark("ts", lateness).groupBy("node")
        return keyed.transformWithStateInPandas(WindowState(window_seconds * 1000), OUT, "append", "EventTime")
    asked = rows.where("ask is not null").select("node", "ask", F.col("ts").alias("t"))
    events = rows.where("ask is null").select("node", "nbr", "ts")
    reach = F.expr(f"interval {int(window_seconds)} seconds")
    # both sides by stretches of the window's length: a query meets the events of its own stretch and of the one before
    part = lambda c: F.floor(F.unix_seconds(c) / window_seconds)
    near = asked.withColumn("part", F.explode(F.array(part("t") - 1, part("t")))).join(events.withColumn("part", part("ts")), ["node", "part"]).where((F.col("ts") < F.col("t")) & (F.col("ts") >= F.col("t") - reach))
    found = near.groupBy("node", "ask", "t", "nbr").agg(F.count("*").alias("n"))
    bare = asked.join(found, ["node", "ask", "t"], "left_anti").select("node", "ask", "t", F.lit(None).cast("long").alias("nbr"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(bare)
