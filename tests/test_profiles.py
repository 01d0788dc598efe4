"""Vector operators meet only what a query's score needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.operators import profiles


def graph(spark, monkeypatch):
    events = spark.createDataFrame([(1, 2, 5, 1), (2, 3, 6, 2), (4, 2, 7, 3), (9, 1, 7, 4), (3, 1, 8, 5)], "u int, i int, ts int, eid int").withColumn("r", F.lit(0))
    q = spark.createDataFrame([(1, 0, 1, 2, 9), (2, 0, 1, 9, 9), (3, 0, 8, 2, 9), (4, 0, 9, 8, 10), (5, 0, 3, 1, 6)], "eid int, k int, src int, tgt int, t int")
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "node int, vector array<float>")
    rows, write = {}, profiles.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(profiles, "written", counted)
    return events, q, vectors, rows


def test_smoothing_at_a_time_asks_for_queries_with_two_vectors_alone(spark, monkeypatch):
    events, q, vectors, rows = graph(spark, monkeypatch)
    got = {r["eid"]: r["score"] for r in profiles.smoothed_at_time(events, q, vectors, 4).collect()}
    v = {1: np.array([0.6, 0.8]), 2: np.array([1.0, 0.0]), 3: np.array([0.0, 1.0])}
    told = [(a, b, ts) for u, i, ts in ((1, 2, 5), (2, 3, 6), (3, 1, 8)) for a, b in ((u, i), (i, u))]
    degree = lambda n, t: 1 + sum(a == n and t - 4 <= ts < t for a, _, ts in told)

    def at(n, t):
        x = v[n] / degree(n, t) + sum(v[b] / np.sqrt(degree(n, t) * degree(b, t)) for a, b, ts in told if a == n and t - 4 <= ts < t)
        return x / np.linalg.norm(x)

    want = {1: at(1, 9) @ at(2, 9), 2: -1.0, 3: -1.0, 4: -1.0, 5: at(3, 6) @ at(1, 6)}
    assert got == pytest.approx(want)
    assert rows["asked"] == 4 == rows["smoothed"]


def test_history_profile_moves_vectors_for_targets_with_one(spark, monkeypatch):
    events, q, vectors, rows = graph(spark, monkeypatch)
    got = {r["eid"]: r["score"] for r in profiles.history_profile(events, q, vectors).collect()}
    p = np.array([1.0, 1.0]) / np.sqrt(2)  # of 2 and 3
    assert got == pytest.approx({1: p[0], 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.8})
    assert rows["scored"] == 3 and rows["marked"] == 5
