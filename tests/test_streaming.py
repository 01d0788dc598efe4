"""Streams against the plans of the same rows as tables: order of arrival, replays, backups and bounded state."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweft.operators import profiles, scorers
from chronoweft.streaming import memory, online, rolling

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(df, folder, key, batches):
    for b in batches:
        df.where(F.col(key) == b).drop(key).coalesce(1).write.mode("append").parquet(f"file://{folder}")


def run(df, folder, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{folder}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def times(df):
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_rolling_window_of_a_shuffled_stream_equals_the_plan(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(1, 3), 1_600_000_000 + 60 * n + rng.randint(0, 59), rng.randint(1, 4), None if rng.random() < 0.7 else n) for n in range(90)]
    # rows arrive up to 20 minutes late
    at = sorted(range(90), key=lambda n: rows[n][1] + rng.randint(0, 1200))
    table = [(*rows[n], place // 20) for place, n in enumerate(at)]
    end = [(9, 1_600_000_000 + 90 * 60 + d, 1, None, 5 + i) for i, d in enumerate((7200, 7300))]
    df = times(rocks.createDataFrame(table + end, "node long, s long, nbr long, ask long, batch int")).select("node", "ts", "nbr", "ask", "batch")
    files(df, tmp_path / "in", "batch", range(7))
    stream = read(rocks, tmp_path / "in", df.drop("batch").schema)
    run(rolling.rolling_neighbors(stream, 600, "30 minutes"), tmp_path / "cp", "rolling", "append")
    got = sorted(map(str, rocks.table("rolling").collect()))
    want = sorted(map(str, rolling.rolling_neighbors(df.drop("batch"), 600).collect()))
    assert got == want and len(want) > 25
    # the window of nodes that no row came for is forgotten
    held = rocks.read.format("statestore").option("stateVarName", "events").load(f"file://{tmp_path}/cp")
    assert {r["n"] for r in held.select("key.node").withColumnRenamed("node", "n").collect()} <= {9}


def test_memory_bank_of_a_stream_equals_the_plan_and_is_restored(rocks, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), 1_600_000_000 + 10 * n, n, rng.random(), n // 15) for n in range(90)]
    df = times(rocks.createDataFrame(rows, "user_id long, s long, event_id long, value double, batch int")).select("user_id", "ts", "event_id", "value", "batch")
    want = {r["user_id"]: r for r in memory.memory_bank(df).collect()}
    files(df, tmp_path / "a", "batch", range(3))
    files(df, tmp_path / "b", "batch", range(3, 6))
    schema = df.drop("batch").schema
    run(memory.memory_bank(read(rocks, tmp_path / "a", schema)), tmp_path / "cp1", "bank_a", "update")
    memory.backup(rocks, f"file://{tmp_path}/cp1", f"file://{tmp_path}/bank")
    saved = memory.restore(rocks, f"file://{tmp_path}/bank")
    half = {r["user_id"]: r for r in memory.memory_bank(df.where("batch < 3")).collect()}
    for r in saved.collect():
        assert r["memory"] == pytest.approx(half[r["user_id"]]["memory"]) and r["at"] == half[r["user_id"]]["at"] and r["message"] == half[r["user_id"]]["message"]
    run(memory.memory_bank(read(rocks, tmp_path / "b", schema), restored=saved), tmp_path / "cp2", "bank_b", "update")
    memory.backup(rocks, f"file://{tmp_path}/cp2", f"file://{tmp_path}/bank2")
    got = {r["user_id"]: r for r in memory.restore(rocks, f"file://{tmp_path}/bank2").collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r["memory"] == pytest.approx(want[k]["memory"]) and (r["updated"], r["message"], r["at"]) == (want[k]["updated"], want[k]["message"], want[k]["at"])


def test_idle_nodes_are_forgotten(rocks, tmp_path):
    rows = [(n, 1_600_000_000 + 100 * n, n, 1.0, n // 5) for n in range(40)]
    df = times(rocks.createDataFrame(rows, "user_id long, s long, event_id long, value double, batch int")).select("user_id", "ts", "event_id", "value", "batch")
    files(df, tmp_path / "in", "batch", range(8))
    run(memory.memory_bank(read(rocks, tmp_path / "in", df.drop("batch").schema), idle_seconds=300, lateness="0 seconds"), tmp_path / "cp", "idle", "update")
    memory.backup(rocks, f"file://{tmp_path}/cp", f"file://{tmp_path}/bank")
    left = {r["user_id"] for r in memory.restore(rocks, f"file://{tmp_path}/bank").collect()}
    assert 39 in left and len(left) <= 10 and min(left) >= 30


def online_rows(spark):
    rng = random.Random(7)
    events = [(rng.randint(1, 8), rng.randint(1, 8), n // 2, 0, n, 1) for n in range(80)]
    q = [(n, k, events[n][0], rng.randint(1, 8), events[n][2]) for n in range(20, 80) for k in (0, 1)]
    return spark.createDataFrame(events, online.EVENTS), spark.createDataFrame(q, online.QUERIES)


def test_online_scores_equal_the_plan_and_replays_change_nothing(spark, tmp_path):
    events, q = online_rows(spark)
    vectors = spark.createDataFrame([(n, [float((n * j) % 5 - 2) for j in range(1, 6)]) for n in range(1, 9)], "node long, vector array<double>")
    rng = random.Random(1)
    score = lambda e, asked: profiles.smoothed_at_time(e, asked, vectors, 12)
    rows = [(r, r["ts"] if r["kind"] == "event" else r["t"]) for r in online.mixed(events, q).collect()]
    rows.sort(key=lambda x: x[1] + rng.randint(0, 6))
    schema = online.mixed(events, q).schema
    batches = [spark.createDataFrame([r for r, _ in rows[at : at + 40]], schema) for at in range(0, len(rows), 40)]
    end = spark.createDataFrame([("event", 1, 2, 200, 0, 999, 1, None, None, None, None)], "kind string, u long, i long, ts long, r long, eid long, label int, k int, src long, tgt long, t long").select(*schema.names)
    scorer = online.OnlineScorer(spark, f"file://{tmp_path}/state", score, 12, lateness=8)
    key = lambda rows: sorted((r["eid"], r["k"], round(r["score"], 9)) for r in rows)
    for n, b in enumerate([*batches, end]):
        scorer.process(b, n)
        if n % 2:
            before = key(scorer.results().collect())
            scorer.process(b, n)  # the batch comes again
            assert key(scorer.results().collect()) == before
    want = key(score(events, q).collect())
    assert key(scorer.results().collect()) == want and len(want) == q.count()
    kept = spark.read.parquet(scorer._path("events", len(batches)))
    assert kept.count() < 30
    # an earlier batch comes again: the state goes back there, and the run from there on gives the same
    for n, b in list(enumerate([*batches, end]))[2:]:
        scorer.process(b, n)
    assert key(scorer.results().collect()) == want
    with pytest.raises(ValueError, match="without the state"):
        scorer.process(end, 99)


def test_online_scorer_runs_in_a_stream(spark, tmp_path):
    events, q = online_rows(spark)
    rows = online.mixed(events, q).withColumn("batch", F.floor(F.coalesce("ts", "t") / 12))
    files(rows, tmp_path / "in", "batch", range(4))
    files(online.mixed(events.limit(1).withColumn("ts", F.lit(500).cast("long")), q.limit(0)).withColumn("batch", F.lit(9)), tmp_path / "in", "batch", [9])
    scorer = online.OnlineScorer(spark, f"file://{tmp_path}/state", scorers.pair_history, 1000)
    stream = read(spark, tmp_path / "in", rows.drop("batch").schema)
    run_ = stream.writeStream.foreachBatch(scorer.process).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run_.awaitTermination(240)
    got = pd.DataFrame([tuple(r) for r in scorer.results().select("eid", "k", "recency", "past").collect()]).sort_values([0, 1]).values.tolist()
    assert got == pd.DataFrame([tuple(r) for r in scorers.pair_history(events, q).select("eid", "k", "recency", "past").collect()]).sort_values([0, 1]).values.tolist()
