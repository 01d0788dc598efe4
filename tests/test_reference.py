"""Temporal operators against hand-made graphs and, on given tables, against DuckDB."""

import functools
import glob
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.operators import history as H
from chronoweft.operators import asof, collaborative, prefix, profiles, ranking, scorers, splits
from chronoweft.plans import features, history, protocol, reference, routing, sampling  # noqa: F401  (they add their queries)
from chronoweft.sources.tables import adjacency, edges, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(0, 1, 3, 1.0), (1, 1, 3, 2.0), (2, 2, 3, 1.0), (3, 2, 3, 2.0)]
    return spark.createDataFrame(rows, "eid long, u long, i long, ts double").selectExpr("*", "0L as r")


@pytest.fixture(scope="module", autouse=True)
def formed_once():
    """Events, queries and fused scores of the smallest tables are the same for all queries here: they are formed once."""
    from chronoweft.sources.written import written

    fused, graph = reference.fused, reference._graph

    def once(spark, d):
        events, q = graph(spark, d)
        return events, written(q, "queries")

    patch = pytest.MonkeyPatch()
    for name, f in (("fused", functools.cache(fused)), ("_graph", functools.cache(once))):
        for module in (reference, sampling, history, protocol, routing, features):
            if hasattr(module, name):
                patch.setattr(module, name, f)
    yield
    patch.undo()


def asked(spark, times, src=1, tgt=2):
    return spark.createDataFrame([(n, 0, src, tgt, float(t)) for n, t in enumerate(times)], "eid long, k int, src long, tgt long, t double")


def test_common_neighbours_strictly_before(spark, tiny):
    got = scorers.common_neighbors(tiny, asked(spark, [0, 1, 1.5, 2, 3])).orderBy("eid").collect()
    assert [r["cn"] for r in got] == [0, 0, 1, 1, 1]
    assert [round(r["aa"], 6) for r in got] == [0, 0, 1.442695, 1.442695, 0.721348]
    assert [r["ra"] for r in got] == [0, 0, 0.5, 0.5, 0.25]


def test_pair_and_target_history(spark, tiny):
    q = asked(spark, [0, 1, 1.5, 2, 3], 1, 3)
    got = scorers.pair_history(tiny, q).orderBy("eid").collect()
    assert [r["recency"] for r in got] == [-1e15, -1e15, -0.5, -1, -1]
    assert [r["past"] for r in got] == [0, 0, 1, 1, 2]
    assert [r["popularity"] for r in scorers.target_history(tiny, q).orderBy("eid").collect()] == [0, 0, 2, 2, 4]


def test_unknown_node_and_self_loop(spark, tiny):
    loop = tiny.limit(0).union(spark.createDataFrame([(9, 5, 5, 1.0, 0)], "eid long, u long, i long, ts double, r long"))
    assert adjacency(loop).count() == 2
    assert scorers.pair_history(loop, asked(spark, [2], 5, 5)).first()["past"] == 2
    assert scorers.common_neighbors(tiny, asked(spark, [3], -1, 99)).first()["cn"] == 0


def test_collaborative_scores_strictly_before(spark, tiny):
    """Item 3 at t=1.5 has the two users 1 and 2 and two events; the source's history is one event of it."""
    q = asked(spark, [1, 1.5, 3], 1, 3)
    assert [r["item_cf"] for r in collaborative.item_cf(tiny, q).orderBy("eid").collect()] == [0, 1.0, 2 * 2 / 4]
    assert [r["user_cf"] for r in collaborative.user_cf(tiny, q).orderBy("eid").collect()] == [0, 2.0, 2 * 1 / 2 + 2 * 1 / 2]


def test_pair_stats_counts_one_direction(spark, tiny):
    got = [tuple(r) for r in collaborative.pair_stats(tiny, asked(spark, [2], 3, 1)).collect()]
    assert got == [(0, 0, 0, 1.0)]


def test_tied_scores(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert ranking.auc_and_ap(rows).first()["auc"] == 0.875
    q = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.1)], "eid long, k int, score double")
    got = ranking.mrr_and_hits(q, "score").first()
    assert (got["mrr"], got["hits_1"]) == (0.5, 1.0)


def test_every_event_of_the_test_split_is_asked(spark):
    events = edges(spark, SF)
    assert events.count() == events.select("eid").distinct().count()
    _, test_time = splits.boundaries(events)
    late = {r["eid"] for r in events.where(events["ts"] > test_time).collect()}
    q = reference.QUERIES["query_table"](spark, SF).collect()
    assert {r["eid"] for r in q if r["k"] == 0} == late and len(q) == 4 * len(late)
    assert queries(events).where("k = 0").count() == events.count()


def test_history_is_the_same_in_blocks_of_any_width(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.randint(0, 40), rng.randint(-5, 5)) for _ in range(400)]
    asked_rows = [(rng.randint(0, 4), rng.randint(-2, 45)) for _ in range(60)]
    events, q = spark.createDataFrame(rows, "k int, ts int, x int"), spark.createDataFrame(asked_rows, "k int, t int")
    aggs = {"n": ("count", F.col("ts")), "total": ("sum", F.col("x")), "last": ("max", F.col("ts")), "least": ("min", F.col("x"))}
    for width in (1, 7, 1000):
        got = {(r["k"], r["t"]): tuple(r)[2:] for r in asof.asof_aggregate(events, q, ["k"], aggs, width=width).collect()}
        for k, t in asked_rows:
            xs = [(ts, x) for c, ts, x in rows if c == k and ts < t]
            want = (len(xs), sum(x for _, x in xs), max(ts for ts, _ in xs), min(x for _, x in xs)) if xs else (0, None, None, None)
            assert got[k, t] == want


def test_history_of_crowded_and_other_keys(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2, None]), rng.randint(0, 40), rng.randint(-5, 5)) for _ in range(400)]
    asked_rows = [(rng.randint(0, 4), rng.randint(-2, 45)) for _ in range(60)] * 2
    events, q = spark.createDataFrame(rows, "k int, ts int, x int"), spark.createDataFrame(asked_rows, "k int, t int")
    aggs = {"n": ("count", F.col("ts")), "total": ("sum", F.col("x")), "last": ("max", F.col("ts"))}
    for most in (100, 1000):
        monkeypatch.setattr(asof, "ROWS", most)
        found = asof.asof_aggregate(events, q, ["k"], aggs)
        # without a crowded key events move once
        assert ("_block" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 100)
        found = found.collect()
        assert len(found) == len(set(asked_rows))
        for r in found:
            xs = [(ts, x) for c, ts, x in rows if c == r["k"] and ts < r["t"]]
            assert tuple(r)[2:] == ((len(xs), sum(x for _, x in xs), max(ts for ts, _ in xs)) if xs else (0, None, None))


def test_shared_contacts_of_crowded_and_other_ends(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, rng.randint(0, 30)]), rng.randint(0, 40), rng.randint(0, 50), i) for i in range(500)]
    asked = [(rng.choice([0, 1, rng.randint(0, 40)]), rng.choice([0, 1, rng.randint(0, 40)]), rng.randint(0, 55)) for _ in range(200)]
    events = spark.createDataFrame(rows, "u int, i int, ts int, eid int").withColumn("r", F.lit(0))
    q = spark.createDataFrame(asked, "src int, tgt int, t int")
    met = lambda n, t: {b if a == n else a for a, b, ts, _ in rows if n in (a, b) and ts < t}
    want = {(a, b, t, n) for a, b, t in asked for n in met(a, t) & met(b, t)}
    for listed in (0, 20, 4096):
        monkeypatch.setattr(scorers, "LISTED", listed)
        got = [tuple(r) for r in scorers.shared_contacts(events, q).select("src", "tgt", "t", "nbr").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_history_profile_sums_only_what_is_asked(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randint(0, 8), rng.randint(0, 8), rng.randint(0, 30), i) for i in range(150)]
    asked = [(i, 0, rng.randint(0, 8), rng.randint(0, 8), rng.randint(0, 33)) for i in range(60)]
    vector = {n: [rng.uniform(-1, 1) for _ in range(5)] for n in (0, 2, 3, 5, 7)}
    events = spark.createDataFrame(rows, "u int, i int, ts int, eid int").withColumn("r", F.lit(0))
    q = spark.createDataFrame(asked, "eid int, k int, src int, tgt int, t int")
    vectors = spark.createDataFrame(list(vector.items()), "node int, vector array<double>")
    unit = {n: np.array(v) / np.linalg.norm(v) for n, v in vector.items()}
    seen = []
    monkeypatch.setattr(profiles, "asof_aggregate", lambda e, a, *rest: (seen.append((e.count(), a.select("node").distinct().count())), asof.asof_aggregate(e, a, *rest))[1])
    for wide, parts in ((2, 3), (32, 1)):
        monkeypatch.setattr(profiles, "WIDE", wide)
        got = {r["eid"]: r["score"] for r in profiles.history_profile(events, q, vectors).collect()}
        for eid, _, src, tgt, t in asked:
            met = [unit[b] for u, i, ts, _ in rows for a, b in ((u, i), (i, u)) if a == src and ts < t and b in unit]
            own = sum(met) if met else unit.get(src)
            want = 0.0 if own is None or tgt not in unit else float(own @ unit[tgt] / np.linalg.norm(own))
            assert got[eid] == pytest.approx(want, abs=1e-9)
        sources = {src for _, _, src, tgt, _ in asked if tgt in unit}
        told = sum(b in unit for u, i, _, _ in rows for a, b in ((u, i), (i, u)) if a in sources)
        assert seen.pop() == (told * parts, len(sources))


def test_a_question_does_not_move_for_each_of_its_latest_events(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, rng.randint(0, 6)]), rng.randint(0, 6), rng.randint(0, 30), i) for i in range(200)]
    asked = [(i, 0, rng.randint(0, 8), rng.randint(0, 8), rng.randint(0, 33)) for i in range(50)]
    events = spark.createDataFrame(rows, "u long, i long, ts int, eid int").withColumn("r", F.lit(0))
    q = spark.createDataFrame(asked, "eid int, k int, src long, tgt long, t int")
    seq = H.numbered_events(events)
    for size in (1, 7, 60):
        out = H.endpoint_history(seq, q, "tgt", size)
        assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row of q for each number asked
        got = {}
        for r in out.collect():
            got.setdefault(r["eid"], []).append((r["age"], r["nbr"], r["role"], r["ts"]))
        sequences = {r["eid"]: [x["nbr"] for x in r["a"]] for r in H.recent_sequences(seq, q, "tgt", size, "a").collect()}
        for eid, _, _, node, t in asked:
            told = sorted(((ts, e, role == "in"), n, role, ts) for u, i, ts, e in rows for a, n, role in ((u, i, "out"), (i, u, "in")) if a == node and ts < t)
            want = [(age, n, role, ts) for age, (_, n, role, ts) in enumerate(told[::-1][:size])]
            assert sorted(got.get(eid, [])) == want and sequences[eid] == [n for _, n, _, _ in want[::-1]]


def test_ranks_totals_and_quantiles_over_ranges(spark):
    rng = random.Random(3)
    values = [rng.choice([None, rng.randint(0, 20) / 2]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    known = [v for v in values if v is not None]
    levels = [0, 0.3, 0.5, 0.77, 1]
    assert prefix.quantiles(df, "v", levels) == pytest.approx(np.quantile(known, levels).tolist())
    assert prefix.quantiles(df.limit(0), "v", [0.5]) == [None]
    numbered = prefix.row_numbers(df, [F.col("v"), F.col("i")], "n").collect()
    order = sorted(range(300), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert {r["i"]: r["n"] for r in numbered} == {i: n for n, i in enumerate(order)}


def test_levels_on_a_bound_and_lowest_of_equal_thresholds(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 2, 3, 3, 3])] + [(9, None)], "i int, s double")
    assert {r["i"]: r["level"] for r in ranking.level_buckets(rows, "s").collect()} == {0: "Low", 1: "Low", 2: "Low", 3: "Modest", 4: "High", 5: "High", 6: "High", 9: "Modest"}
    # thresholds 0.2 and 0.6 both reach 3/4
    scored = spark.createDataFrame([(0, 0.1), (1, 0.2), (0, 0.4), (1, 0.6)], "label int, score double")
    assert ranking.balanced_threshold(scored).first()["threshold"] == 0.2


def test_answer_phrases_durations_and_markup(spark):
    texts = ["Therefore, the answer is: about 123 of 7", "My ANSWER IS: 12.", "1234 then 45 and 6789", "none", "Therefore, the answer is: none. answer is: 8", None]
    got = [tuple(r["p"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse_score(F.col("t")).alias("p")).collect()]
    assert got == [(100, "exact_phrase"), (12, "answer_phrase_fallback"), (45, "last_integer_fallback"), (None, "parse_failed"), (8, "exact_phrase"), (None, "parse_failed")]
    days = spark.createDataFrame([(-1,), (0,), (400,), (730,), (31,)], "d int").select(T.duration_text(F.col("d")).alias("t")).collect()
    assert [r["t"] for r in days] == ["future", "today", "1 year, 1 month, 5 days", "2 years", "1 month, 1 day"]
    html = "&lt;b&gt;x&lt;/b&gt; <![CDATA[y]]><!-- a\nb --><script>z &eacute;&#x41;</script>\u00a0 &amp;lt;"
    assert spark.createDataFrame([(html,)], "h string").select(T.strip_markup(F.col("h")).alias("t")).first()["t"] == "x y z éA &lt;"


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(reference.SQL[name]).df()
    got = reference.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    c = sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[c].map(lambda v: float(v) if isinstance(v, (int, float)) and not pd.isna(v) else None if v is None or v is pd.NA or v != v else str(v)).itertuples(index=False, name=None)))
    assert rows(want) == rows(got)


def test_rows_with_their_histories_move_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 40), rng.choice([None, 3, 4])) for _ in range(400)]
    asked_rows = [(n, rng.randint(0, 4), rng.randint(-2, 45)) for n in range(60)]
    asked_rows += [(100 + n, a, t) for n, a, t in asked_rows]
    events, q = spark.createDataFrame(rows, "k int, ts int, x int"), spark.createDataFrame(asked_rows, "id long, a long, t int")
    aggs = {"n": ("count", F.col("x")), "total": ("sum", F.col("x")), "last": ("max", F.col("ts"))}
    for most in (100, 1000):
        monkeypatch.setattr(asof, "ROWS", most)
        found = asof.asof_attach(events, q, {"a": "k"}, aggs)
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 100)
        got = {r["id"]: tuple(r) for r in found.collect()}
        assert len(got) == len(asked_rows)
        for n, a, t in asked_rows:
            xs = [(ts, x) for c, ts, x in rows if c == a and ts < t]
            known = [x for _, x in xs if x is not None]
            assert got[n] == (n, a, t, len(known), sum(known) if known else None, max(ts for ts, _ in xs) if xs else None)


def test_shuffles_of_a_written_table_are_removed(spark):
    import time

    from chronoweft.sources import written as W

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, setting = files(), spark.conf.get(W.REMOVE_SHUFFLES, None)
    kept = W.written(spark.range(5000).selectExpr("id % 7 AS k", "id").groupBy("k").count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 7 and spark.conf.get(W.REMOVE_SHUFFLES, None) == setting


def test_totals_within_keys_are_dealt_out_by_key_unless_crowded(spark, monkeypatch):
    rows = spark.createDataFrame([(n % 3 if n < 60 else 7, n, n % 5) for n in range(90)], "k long, t long, x long")
    names, kept = [], prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    got = {}
    for most in (10, 1000):
        monkeypatch.setattr(asof, "ROWS", most)
        names.clear()
        totals = prefix.totals_within(rows, ["k"], [F.col("t")], {"upto": "x"}).collect()
        before = prefix.with_previous(rows, ["k"], [F.col("t")], {"last": "x"}).collect()
        assert bool(names) == (most == 10)
        got[most] = {(r["k"], r["t"]): r["upto"] for r in totals}, {(r["k"], r["t"]): r["last"] for r in before}
    assert got[10] == got[1000] and len(got[10][0]) == 90
    assert got[1000][0][7, 61] == 0 + 1 and got[1000][1][7, 60] is None and got[1000][1][7, 61] == 0


def test_markov_asks_for_sums_of_next_baskets(spark, monkeypatch):
    rows = [(1, a, 1) for a in (10, 11, 12)] + [(1, b, 2) for b in (10, 13, 14)] + [(2, 10, 1), (2, 13, 3)]
    events = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "eid long, u long, i long, ts long")
    q = spark.createDataFrame([(9, k, 2, t, 3) for k, t in enumerate((10, 13, 99))] + [(8, 0, 5, 10, 3), (7, 0, 1, 13, 2)], "eid long, k int, src long, tgt long, t long")
    told, once = {}, scorers.asof_attach
    monkeypatch.setattr(scorers, "asof_attach", lambda e, a, on, aggs, **o: (told.setdefault(tuple(on.values()), e.count()), once(e, a, on, aggs, **o))[1])
    got = {(r["eid"], r["k"]): r["markov"] for r in scorers.markov(events, q).collect()}
    assert got == {(9, 0): 1 / 3, (9, 1): 1 / 3, (9, 2): 0.0, (8, 0): 0.0, (7, 0): 0.0}
    # one row for an item of a basket with a next one, not one for each transition
    assert told["a",] == 4 and told["a", "b"] == 10


def test_interval_weights_and_draws_by_node_and_by_block(spark, monkeypatch):
    from chronoweft.operators import sampling as N

    events = spark.createDataFrame([(n, 1 + n % 2, 10 + n % 5, float(n // 3)) for n in range(80)], "eid long, u long, i long, ts double").selectExpr("*", "0L as r")
    q = spark.createDataFrame([(n, 0, 1 + n % 3, 10, float(3 * n)) for n in range(8)], "eid long, k int, src long, tgt long, t double")
    names, kept, got = [], N.written, {}
    monkeypatch.setattr(N, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    for most in (5, 1000):
        monkeypatch.setattr(asof, "ROWS", most)
        names.clear()
        weighed = N.interval_weights(events, 0.1, block=7)
        assert ("weights" in names) == (most == 5)
        drawn = {tuple(r) for r in N.interval_draws(weighed, q, 4).collect()}
        got[most] = {(r["node"], r["seq"]): (r["nbr"], round(r["weight"], 9), round(r["from"], 9), round(r["upto"], 9)) for r in weighed.collect()}, drawn
    assert got[5] == got[1000] and len(got[5][0]) == 160 and len(got[5][1]) == 4 * sum(1 for n in range(1, 8) if n % 3 < 2)
