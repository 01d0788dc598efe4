"""Collaborative scores by sets of hashes, by all users of a target and by rows."""

import random
from math import sqrt

import pytest

from chronoweft.operators import collaborative, scorers


def test_item_cf_of_crowded_and_other_ends_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(rng.randint(0, 12), rng.choice([3, rng.randint(0, 15)]), rng.randint(0, 30)) for _ in range(120)]
    asked = [(n, 0, rng.randint(0, 13), rng.choice([3, rng.randint(0, 16)]), rng.randint(0, 33)) for n in range(80)]
    events, q = spark.createDataFrame(rows, "u long, i long, ts long"), spark.createDataFrame(asked, "eid long, k int, src long, tgt long, t long")
    want = {}
    for eid, _, src, tgt, t in asked:
        past = [(u, i) for u, i, ts in rows if ts < t]
        users = lambda i: {u for u, x in past if x == i}
        degree = lambda i: sum(x == i for _, x in past)
        want[eid] = sum(len(users(tgt) & users(j)) / sqrt(degree(tgt) * degree(j)) for u, j in past if u == src and degree(tgt))
    met, write = [], collaborative.written

    def counted(df, name):
        out = write(df, name)
        if name == "users-met":
            met.append(out.count())
        return out

    monkeypatch.setattr(collaborative, "written", counted)
    for listed, reach in ((4096, 65536), (4096, 20), (6, 20)):
        for module in (collaborative, scorers):
            monkeypatch.setattr(module, "LISTED", listed)
        monkeypatch.setattr(collaborative, "REACH", reach)
        assert {r["eid"]: r["item_cf"] for r in collaborative.item_cf(events, q).collect()} == pytest.approx(want)
    # a set of hashes leaves out users who share nothing with the source, a source without a set asks for all, a crowded target for none
    assert met[2] < met[0] <= met[1]


def test_users_of_a_target_met_later_are_not_all_asked_for(spark, monkeypatch):
    # source 0 buys item 1 at time 9 only: of its 40 users one shares another item with the source
    rows = [(u, 1, 5) for u in range(1, 41)] + [(0, 1, 9), (0, 2, 3), (7, 2, 4)]
    events, q = spark.createDataFrame(rows, "u long, i long, ts long"), spark.createDataFrame([(0, 0, 0, 1, 9)], "eid long, k int, src long, tgt long, t long")
    met, write = [], collaborative.written

    def counted(df, name):
        out = write(df, name)
        if name == "users-met":
            met.append({r["u"] for r in out.collect()})
        return out

    monkeypatch.setattr(collaborative, "written", counted)
    (got,) = collaborative.item_cf(events, q).collect()
    assert got["item_cf"] == pytest.approx(1 / sqrt(40 * 2))
    assert 7 in met[0] and len(met[0]) < 5
