"""Work of routing queries: what is looked up, drawn or read once."""

import random

from pyspark.sql import functions as F

from chronoweft.operators import history, routing
from chronoweft.plans import routing as plans
from chronoweft.sources import tables


def rows(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(n, k, rng.randint(0, 4), rng.randint(0, 6), int(k == 0)) for n in range(30) for k in range(4)], "eid long, k int, a int, b int, label int")


def test_marginal_utility_looks_few_values_up_without_gathering_rows(spark, monkeypatch):
    few = routing.marginal_utility(rows(spark), "a", "b")
    assert few._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    monkeypatch.setattr(routing, "HELD", 0)
    many = routing.marginal_utility(rows(spark), "a", "b")
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_out_of_fold_views_draw_a_fold_once_for_each_seed(spark, monkeypatch):
    drawn, draw = [], routing.draw
    monkeypatch.setattr(routing, "draw", lambda *a: (drawn.append(a[-1]), draw(*a))[1])
    got = routing.out_of_fold_views(rows(spark).selectExpr("*", "b > 2 AS c"), ["a"], ["b"], "c", "label", "eid", (0, 1, 2))
    assert drawn == [0, 1, 2] and got.columns[-2:] == ["no_call", "called"] and got.where("called is null").count() == 0


def test_frozen_levels_reads_the_events_once(spark, monkeypatch):
    read, edges = [], tables.edges
    monkeypatch.setattr(tables, "edges", lambda *a: (read.append(a), edges(*a))[1])
    out = plans.frozen_levels(spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and out.columns == ["eid", "k", "level"] and out.count() > 0


def test_common_neighbor_rows_take_degrees_along(spark, monkeypatch):
    monkeypatch.setattr(history, "asof_aggregate", None)  # no table of degrees by (node, t) is made and joined
    events = spark.createDataFrame([(1, 3, 1, 1), (2, 3, 2, 2), (1, 4, 3, 3), (2, 4, 4, 4), (5, 4, 5, 5), (2, 6, 9, 6), (1, 6, 1, 7)], "u long, i long, ts long, eid long").withColumn("r", F.lit(0))
    q = spark.createDataFrame([(1, 0, 1, 2, 8), (2, 0, 1, 5, 8)], "eid long, k int, src long, tgt long, t long")
    got = history.common_neighbor_rows(events, q, 5).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 3, 2), (1, 0, 1, 4, 3), (2, 0, 0, 4, 3)]
