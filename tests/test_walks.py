"""Walks to the latest earlier events, held as lists."""

import random
from collections import Counter

import pytest

from chronoweft.operators import asof, collaborative, history
from chronoweft.plans.history import walk_appearances  # noqa: F401
from chronoweft.plans.reference import QUERIES, SQL


def _graph(spark, rng):
    rows = [(n, rng.choice([0, rng.randint(0, 9)]), rng.choice([0, rng.randint(0, 9)]), rng.randint(0, 30)) for n in range(150)]
    asked = [(n, 0, rng.randint(0, 10), rng.randint(0, 10), rng.randint(0, 33)) for n in range(40)]
    return rows, asked, spark.createDataFrame([(*r, 0) for r in rows], "eid long, u long, i long, ts long, r long"), spark.createDataFrame(asked, "eid long, k int, src long, tgt long, t long")


def _step(rows, states, fanout):
    adj = [(u, i, ts, eid) for eid, u, i, ts in rows] + [(i, u, ts, eid) for eid, u, i, ts in rows]
    out = Counter()
    for (node, at), m in states.items():
        for _, nbr, ts, _ in sorted((x for x in adj if x[0] == node and x[2] < at), key=lambda x: (x[2], x[3], x[1]))[-fanout:]:
            out[nbr, ts] += m
    return out


@pytest.mark.parametrize("listed", [4096, 5])
def test_sampled_pagerank_makes_only_leading_last_steps_and_equals_brute_force(spark, monkeypatch, listed):
    rows, asked, events, q = _graph(spark, random.Random(3))
    monkeypatch.setattr(collaborative, "LISTED", listed)
    sizes, write = {}, collaborative.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(collaborative, "written", counted)
    want = {}
    for eid, _, src, tgt, t in asked:
        states, want[eid] = Counter({(src, t): 1}), 0
        for hop in (1, 2, 3):
            states = _step(rows, states, 4)
            want[eid] += sum(m for (node, _), m in states.items() if node == tgt) * 0.15 * 0.85**hop / 4**hop
    got = {r["eid"]: r["ppr"] for r in collaborative.sampled_pagerank(events, q, 4, 3).collect()}
    assert got == pytest.approx(want)
    assert sizes["hits"] <= 3 * len(asked) and sizes["steps"] > 0


def test_walks_start_from_both_ends_of_every_query(spark):
    rows, asked, events, q = _graph(spark, random.Random(5))
    got = {(r["eid"], r["root"], r["hop"], r["node"]): r["share"] for r in history.walk_appearances(history.numbered_events(events), q, 3, 2).collect()}
    want = Counter()
    for eid, _, src, tgt, t in asked:
        for root, of in (("src", src), ("tgt", tgt)):
            states = Counter({(of, t): 1})
            for hop in range(3):
                for (node, _), m in states.items():
                    want[eid, root, hop, node] += m / 3**hop
                states = _step(rows, states, 3)
    assert got == pytest.approx(dict(want))
    assert "k = 0" not in SQL["walk_appearances"].split("w0 AS")[1]
    assert {r["k"] for r in QUERIES["walk_appearances"](spark, "/root/testdata/sf0.001").select("k").distinct().collect()} == {0, 1, 2, 3}


def test_latest_events_stand_in_stretches_that_hold_few_of_them_twice(spark):
    seq = spark.createDataFrame([(1, n, n * 10) for n in range(1, 101)], "node long, seq long, x long")
    asked = spark.createDataFrame([(1, n) for n in range(0, 101)] + [(2, 0)], "node long, n long")
    for r in asof.with_latest(asked, seq, "node", "n", 3, ["x"], "e").collect():
        assert [e["x"] for e in r["e"] or []] == [n * 10 for n in range(max(1, r["n"] - 2), r["n"] + 1)] * (r["node"] == 1)
