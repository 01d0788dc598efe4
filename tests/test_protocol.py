"""Protocol, draws, files, fits and streams: properties, errors, and brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.operators import alignment, history, profiles, protocol, ranking, registry, routing, sampling
from chronoweft.sources import files, tables

EVENTS = "eid long, u long, r long, i long, ts long, label int"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(n, rng.randint(1, 30), rng.randint(0, 3), rng.randint(1, 30), n // 3, 1) for n in range(600)], EVENTS)


def test_protocol_is_clean_and_leaks_are_found(spark, events):
    p = protocol.training_protocol(events)
    observed = protocol.protocol_history(p)
    q = tables.queries(observed, negatives=1)
    seq = history.numbered_events(observed)
    past = history.endpoint_history(seq, q, "src", 5)
    protocol.require_clean(protocol.violations(p, q, past, q.where("k > 0")))
    found = {r["rule"]: r["n"] for r in protocol.violations(p, q, past.withColumn("ts", F.col("ts") + 500), q.where("k > 0").withColumn("tgt", F.lit(99).cast("long"))).collect()}
    assert found["late_history"] > 0 and found["foreign_negatives"] == q.where("k > 0").count() and found["unobserved_ends"] == 0
    with pytest.raises(ValueError, match="leakage"):
        protocol.require_clean(protocol.violations(p, q, past.withColumn("ts", F.col("ts") + 500), q))
    with pytest.raises(ValueError):
        protocol.require_scope(observed.withColumn("scope", F.when(F.col("eid") % 2 == 0, "observed_train")))
    with pytest.raises(ValueError):
        protocol.require_scope(events)
    with pytest.raises(ValueError):
        protocol.training_protocol(events.withColumn("u", -F.col("u")))


def test_identity_join_is_one_to_one(spark):
    rows = lambda ids: spark.createDataFrame([(i, 1, 2, 3, i % 2) for i in ids], "query_id long, source_id long, target_id long, timestamp long, label int")
    assert protocol.identity_join(rows([1, 2]), rows([2, 1]).withColumn("s", F.lit(0.5))).count() == 2
    for a, b in (([1, 2], [1]), ([1], [1, 2]), ([1, 1], [1]), ([1], [1, 1])):
        with pytest.raises(ValueError):
            protocol.identity_join(rows(a), rows(b))


def test_fingerprint_follows_values_and_order(spark, events):
    digest = lambda df: protocol.fingerprint(df, ["u", "i", "ts"], ["ts", "eid"], block=64)
    assert digest(events) == digest(events.orderBy(F.desc("eid")).repartition(3))
    assert digest(events) != digest(events.withColumn("i", F.when(F.col("eid") == 5, 0).otherwise(F.col("i")))) != digest(events.withColumn("eid", -F.col("eid")))


def test_endpoint_history_keeps_direction_and_caps(spark):
    rows = [(n, n % 5, n, (n * 3) % 5, n % 20, 1) for n in range(130)]
    events = spark.createDataFrame(rows, EVENTS)
    seq = history.numbered_events(events)
    q = spark.createDataFrame([(e, 0, e % 6, 0, t) for e, t in enumerate([0, 5, 19, 20, 20, 20])], "eid long, k int, src long, tgt long, t long")
    for cap in (1, 3, 47, 50):
        got = {}
        for r in history.endpoint_history(seq, q, "src", cap).collect():
            got.setdefault(r["eid"], []).append((r["age"], r["nbr"], r["role"], r["ts"]))
        for e, _, node, _, t in q.collect():
            ends = [(ts, n, role, other) for n, u, _, i, ts, _ in rows for here, other, role in ((u, i, "out"), (i, u, "in")) if here == node and ts < t]
            ends.sort(key=lambda x: (x[0], x[1], x[2] != "out"))
            assert sorted(got.get(e, [])) == [(a, o, role, ts) for a, (ts, _, role, o) in enumerate(reversed(ends[-cap:]))], (cap, e)


def test_directed_count_is_not_changed_by_reverse_events(spark):
    from chronoweft.operators.collaborative import pair_stats

    rows = [(0, 1, 0, 2, 1), (1, 1, 1, 3, 2), (2, 1, 2, 3, 3), (3, 2, 3, 1, 4), (4, 4, 4, 1, 5)]
    events = spark.createDataFrame([(*r, 1) for r in rows], EVENTS)
    q = spark.createDataFrame([(n, 0, 1, n, 10) for n in (2, 3, 4)], "eid long, k int, src long, tgt long, t long")
    assert [(r["directed"], r["last_ts"]) for r in pair_stats(events, q).orderBy("eid").collect()] == [(1, 4), (2, 3), (0, 5)]


def test_draws_keep_their_rules(spark, events):
    batch = events.where("ts between 150 and 170")
    positives = batch.select("eid", F.col("u").alias("src"), F.col("ts").alias("t"))
    taken = {(r["u"], r["i"]) for r in batch.collect()}
    drawn = sampling.checked_negatives(events, positives, 3, batch).collect()
    assert len(drawn) == 3 * positives.count() and not {(r["src"], r["tgt"]) for r in drawn} & taken
    seen = {}
    for r in events.where("ts < 150").orderBy("ts").collect():
        seen.setdefault((r["u"], r["i"]), [r["ts"], 0])[1] = r["ts"]
    rows, late = events.collect(), events.where("ts >= 150").select("eid", F.col("u").alias("src"), F.col("ts").alias("t"))
    for options, good in (({"least_gap": 20}, lambda f, last, start: start - last >= 20), ({"observed_until": 145}, lambda f, last, start: f > 145)):
        got = sampling.batch_negatives(events, late, 16, **options).collect()
        assert len(got) == late.count() and {r["kind"] for r in got} == {"historical", "random"} or "least_gap" in options
        by_batch = {}
        for r in got:
            by_batch.setdefault(r["batch"], []).append(r)
        for batch_rows in by_batch.values():
            start, end = min(r["t"] for r in batch_rows), max(r["t"] for r in batch_rows)
            here = {(r["u"], r["i"]) for r in rows if start <= r["ts"] <= end}
            past = {}
            for r in rows:
                if r["ts"] < start:
                    past.setdefault((r["u"], r["i"]), [r["ts"], 0])[1] = r["ts"]
            may = {p for p, (f, last) in past.items() if p not in here and good(f, last, start)}
            old = [(r["src"], r["tgt"]) for r in batch_rows if r["kind"] == "historical"]
            assert len(set(old)) == len(old) == min(len(batch_rows), len(may)) and set(old) <= may
            assert not {(r["src"], r["tgt"]) for r in batch_rows} & here
    pools = {}
    for r in sampling.training_pools(positives.withColumn("tgt", F.lit(7).cast("long")), events.select(F.col("i").alias("node")), 2, 8).collect():
        pools.setdefault((r["eid"], r["pool"]), []).append((r["place"], r["target"], r["src"]))
    for rows in pools.values():
        targets = [t for _, t, _ in sorted(rows)]
        assert targets[0] == 7 and len(set(targets)) == len(targets) == 8 and rows[0][2] not in targets[1:]
    with pytest.raises(ValueError):
        sampling.recent_pairs(spark.createDataFrame([(1, 0, 1, 2, 3)], "eid long, k int, src long, tgt long, t long"), 5)


def test_negatives_where_nearly_all_is_taken(spark):
    rows = [(n, 1, 0, n + 2, 5, 1) for n in range(60)] + [(100 + n, 2, 0, 70 + n, 1, 1) for n in range(2)]
    events = spark.createDataFrame(rows, EVENTS)
    positives = events.where("u = 1").select("eid", F.col("u").alias("src"), F.col("ts").alias("t"))
    drawn = sampling.checked_negatives(events, positives, 2, events).collect()
    assert len(drawn) == 120 and {r["tgt"] for r in drawn} == {70, 71}
    got = sampling.batch_negatives(events, positives, 60, observed_until=4).collect()
    assert len(got) == 60 and {(r["src"], r["tgt"], r["kind"]) for r in got} <= {(1, 70, "random"), (1, 71, "random")}
    got = sampling.batch_negatives(events, positives, 30).collect()
    assert len(got) == 60 and sorted((r["batch"], r["src"], r["tgt"]) for r in got if r["kind"] == "historical") == [(b, 2, t) for b in (0, 1) for t in (70, 71)]


def test_time_aware_draws_have_their_chances(spark):
    times = [0, 1, 1, 3, 10, 11, 12, 2000]
    events = spark.createDataFrame([(n, 1, 0, 10 + n, ts, 1) for n, ts in enumerate(times)], EVENTS)
    weighed = sampling.interval_weights(events, 0.5, block=3)
    q = spark.createDataFrame([(n, 0, 1, 5, 12) for n in range(4000)], "eid long, k int, src long, tgt long, t long")
    got = sampling.interval_draws(weighed, q, 4).collect()
    x = np.exp(0.5 * (np.array(times[:6], float) - 2000))
    with np.errstate(invalid="ignore"):
        share = x / np.cumsum(x)
    chance = np.exp(np.where(np.isnan(share), -1e10, share))
    chance = np.full(6, 1 / 6) if not chance.sum() else chance / chance.sum()
    found = np.bincount([r["nbr"] - 10 for r in got], minlength=6) / len(got)
    assert len(got) == 16000 and found == pytest.approx(chance, abs=0.02)
    late = spark.createDataFrame([(n, 0, 1, 5, 2001) for n in range(3000)], "eid long, k int, src long, tgt long, t long")
    x = np.exp(0.01 * (np.array(times, float) - 2000))
    chance = np.exp(x / np.cumsum(x))
    rows = sampling.interval_draws(sampling.interval_weights(events, 0.01, block=3), late, 3).orderBy("eid", "slot").collect()
    assert np.bincount([r["nbr"] - 10 for r in rows], minlength=8) / len(rows) == pytest.approx(chance / chance.sum(), abs=0.02)
    assert all(a["ts"] <= b["ts"] for a, b in zip(rows, rows[1:]) if a["eid"] == b["eid"])


def test_population_ranks_and_quantiles_equal_brute_force(spark):
    from chronoweft.operators.population import Population

    rng = random.Random(3)
    value = lambda: float(rng.choice([rng.randint(0, 9), 3, 3, rng.random()]))
    joined = [(rng.choice("ab"), float(rng.choice([rng.randint(0, 12), 5])), value(), 1) for _ in range(300)]
    points = joined + [(g, t + rng.randint(0, 4), v, -1) for g, t, v, _ in joined[::3]]
    asked = [(rng.choice("abc"), float(rng.randint(-1, 16)), value()) for _ in range(150)]
    p, a = spark.createDataFrame(points, "g string, t double, v double, w int"), spark.createDataFrame(asked, "g string, t double, v double")
    for size in (9, 50):
        pop = Population(p, a, a, ["g"], size)
        ranks = pop.ranks()
        rows, bounds = ranks.collect(), pop.quantiles(ranks, [0.3, 0.7]).collect()

        def held(g, t):
            n = {}
            for h, at, v, w in points:
                if h == g and at < t:
                    n[v] = n.get(v, 0) + w
            return sorted(v for v, c in n.items() for _ in range(c))

        assert len(rows) == len(set(asked))
        for r in rows:
            m = held(r["g"], r["t"])
            assert (r["below"], r["upto"], r["total"]) == (sum(v < r["v"] for v in m), sum(v <= r["v"] for v in m), len(m))
        for r in bounds:
            assert [r["q0"], r["q1"]] == pytest.approx(np.quantile(held(r["g"], r["t"]), [0.3, 0.7]).tolist())
        assert len(bounds) == len({(g, t) for g, t, _ in asked if held(g, t)})


def test_a_hub_is_numbered_in_many_ranges(spark, monkeypatch):
    from chronoweft.operators import prefix

    sizes, real = [], prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: (sizes.append(out := real(df, name)), out)[1])
    rows = spark.createDataFrame([(1 if n % 2 else 2 + n % 50, n // 5, n) for n in range(20000)], "node long, ts long, eid long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.numbers_within(rows, ["node"], [F.col("ts"), F.col("eid")], "seq")
        w = {}
        for r in sorted(got.collect(), key=lambda r: r["eid"]):
            w[r["node"]] = w.get(r["node"], 0) + 1
            assert r["seq"] == w[r["node"]]
        per = [r["count"] for r in sizes[0].where("node = 1").groupBy("_range").count().collect()]
        assert len(per) > 1 and max(per) < 10000
        before = prefix.with_previous(rows, ["node"], [F.col("ts"), F.col("eid")], {"last": "eid"}).where("node = 1").orderBy("eid").collect()
        assert [r["last"] for r in before] == [None, *(r["eid"] for r in before[:-1])]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_isotonic_fit_over_many_groups(spark):
    rng = np.random.default_rng(1)
    x = rng.random(20000)
    for y in (np.clip(x + rng.normal(0, 0.3, len(x)), 0, 1), -x, x):
        rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
        order = np.argsort(x)
        a, b, w, s = alignment.pool(x[order], x[order], np.ones(len(x)), y[order])
        fit = alignment.fit_isotonic(rows, "x", "y", group=500)
        got = fit.orderBy("n").collect()
        assert all(p["value"] <= r["value"] for p, r in zip(got, got[1:]))
        asked = np.concatenate([rng.random(200) * 1.2 - 0.1, x[:50]])
        found = alignment.apply_isotonic(spark.createDataFrame([(float(v),) for v in asked], "x double"), "x", fit, "v").collect()
        value = np.repeat([t / n for n, t in zip(w, s)], np.array(w).astype(int))
        assert [r["v"] for r in sorted(found, key=lambda r: r["x"])] == pytest.approx(np.interp(np.sort(asked), x[order], value).tolist())


def test_files_are_checked(spark, events, tmp_path):
    path = f"file://{tmp_path}/e"
    events.select("label", "ts", "i", "u").write.option("header", True).csv(path)
    got = tables.read_edges_csv(spark, path)
    assert got.columns == ["u", "r", "i", "ts", "label"] and got.agg(F.sum("r")).first()[0] == 0 and got.count() == 600
    events.select("ts", "i", "u").write.option("header", True).csv(path + "2")
    with pytest.raises(ValueError, match="label"):
        tables.read_edges_csv(spark, path + "2")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, prompt string")
    files.write_prompts(rows, path + "3")
    assert files.read_prompts(spark, path + "3", "query_id long").count() == 2
    rows.withColumn("prompt_sha256", F.lit("0")).write.json(path + "4")
    with pytest.raises(ValueError, match="changed"):
        files.read_prompts(spark, path + "4", "query_id long").count()
    files.append_debug_rows(rows, path + "5")
    files.append_debug_rows(rows, path + "5")
    assert spark.read.json(path + "5").count() == 4
    files.write_result(spark, {"auc": 0.5}, path + "6")
    assert spark.read.text(path + "6").first()[0] == '{"auc": 0.5}'
    runs = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.0), ("b", 1, 1.0)], "setting string, seed int, auc double")
    assert {r["setting"]: (r["mean_auc"], round(r["std_auc"], 6)) for r in files.summarise(runs, ["auc"]).collect()} == {"a": (2.0, 1.414214), "b": (1.0, 0.0)}
    with pytest.raises(ValueError):
        files.summarise(runs.where("not (setting = 'b' and seed = 1)"), ["auc"])


def test_isotonic_quantile_and_mixture_fits(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 200) / 2, rng.random(200)
    rows = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "eid long, k int, x double, y double")
    blocks: list[list[float]] = []  # pool adjacent violators over the means of equal x
    for v in np.unique(x):
        blocks.append([y[x == v].mean(), (x == v).sum(), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    fitted = np.repeat([b[0] for b in blocks], [b[2] for b in blocks])
    asked = np.array([-1, 0, 0.25, 3.1, 5.5, 9])
    got = alignment.apply_isotonic(spark.createDataFrame([(float(a),) for a in asked], "a double"), "a", alignment.fit_isotonic(rows, "x", "y"), "v").orderBy("a").collect()
    assert [r["v"] for r in got] == pytest.approx(np.interp(asked, np.unique(x), fitted).tolist())
    aligned = {r["eid"]: r["v"] for r in routing.align_by_quantile(rows, "x", rows, "y", "v").collect()}
    rank = np.array([((x < v).sum() + (x <= v).sum() - 1) / 2 for v in x])
    assert [aligned[i] for i in range(200)] == pytest.approx(np.quantile(y, rank / 199).tolist())
    z = np.round(np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 1, 100)]), 2)
    fit = routing.mixture(spark.createDataFrame([(float(v),) for v in z], "z double"), "z")
    assert fit["means"] == pytest.approx([0, 6], abs=0.3) and fit["weights"] == pytest.approx([0.75, 0.25], abs=0.03)
    assert routing.mixture(spark.createDataFrame([(2.0,)] * 3, "z double"), "z")["means"] == [2.0, 2.0]


def test_out_of_fold_fit_never_sees_its_group(spark):
    rng = random.Random(7)
    rows = [(g, k, float(x := rng.random()), 3 * x + 1) for g in range(40) for k in range(3)]
    got = routing.out_of_fold(spark.createDataFrame(rows, "eid long, k int, x double, y double"), ["x"], "y", "eid", ridge=1e-9).collect()
    assert all(abs(r["predicted"] - r["y"]) < 1e-4 for r in got) and len({(r["eid"], r["fold"]) for r in got}) == 40


def test_pairwise_ridge_prefers_the_telling_feature(spark):
    rng = random.Random(8)
    rows = [(e, k, float(k == 0) + rng.random() / 4, rng.random()) for e in range(60) for k in range(3)]
    w = profiles.pairwise_ridge(spark.createDataFrame(rows, "eid long, k int, a double, b double"), ["a", "b"], 0.01)
    assert w["a"] > 5 * abs(w["b"])


def test_scorers_by_name(spark, events):
    q = tables.queries(events, events.where("ts > 180"), negatives=1)
    assert set(registry.scores(events, q, ["past", "ra"]).columns) == {"eid", "k", "src", "tgt", "t", "past", "ra"}
    registry.register(["zero"], lambda e, q: q.select("eid", "k", F.lit(0).alias("zero")))
    assert registry.scores(events, q, ["zero"]).where("zero = 0").count() == q.count()
    with pytest.raises(ValueError):
        registry.scores(events, q, ["nothing"])


def test_text_columns(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c.alias("x")).first()["x"]
    c = F.col("c0")
    assert one(T.labelled_fields(c, ["Title", "Category"]), "x title : A. Category: b. TITLE: C .") == {"title": "C", "category": "b"}
    assert one(T.dedupe(F.split(c, ",")), "a, B., A ,,b") == ["a", "B"]
    assert tuple(one(T.city_zip(c), "Name: x, 1 St, Big Town , CA 90001-1234. Category: y, Z, NY 11111")) == ("Big Town, CA", "90001")
    assert tuple(one(T.city_zip(c), "Title: x, Big Town, CA 90001")) == ("", "")
    assert one(T.shorten_words(c, 2), " a  b, c") == "a b..." and one(T.shorten(c, 5), "abcdefg") == "ab..." and one(T.shorten(c, 7), "abcdefg") == "abcdefg"
    assert one(T.entity_type(c), "The Rebel state") == "Armed Group" and one(T.entity_type(c), "Egypt") == "Nation/Country" and one(T.entity_type(c), "x") == "Political Actor"
    assert one(T.entity_meaning(c), "summary: a EntityMeaning= b  c;InteractionSummary=d") == "b c" and one(T.entity_meaning(c), " x ") == "x"


def test_stream_keeps_the_last_message(spark, tmp_path):
    from chronoweft.streaming.memory import last_messages

    rng = random.Random(9)
    rows = [(rng.randint(0, 4), 1_600_000_000 + rng.randint(0, 50), i, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id long, s long, event_id long, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "value")
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    run = last_messages(stream).writeStream.outputMode("update").format("memory").queryName("last_rows").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {}
    for r in spark.table("last_rows").collect():
        if r["n"] > got.get(r["user_id"], (None,) * 4)[3] if r["user_id"] in got else True:
            got[r["user_id"]] = (r["ts"], r["event_id"], r["value"], r["n"])
    assert got == {r["user_id"]: (r["ts"], r["event_id"], r["value"], r["n"]) for r in last_messages(df).collect()}


def test_marginal_utility_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(e, k, rng.randint(0, 5), rng.randint(0, 5), int(rng.random() < 0.4)) for e in range(20) for k in range(3)]
    got = {(r["eid"], r["k"]): r["utility"] for r in routing.marginal_utility(spark.createDataFrame(rows, "eid long, k int, a int, b int, label int"), "a", "b").collect()}
    win = lambda s, others, up: sum((s > o if up else o > s) + 0.5 * (s == o) for o in others) / len(others)
    pos, neg = [r[2] for r in rows if r[4]], [r[2] for r in rows if not r[4]]
    for e, k, a, b, y in rows:
        assert math.isclose(got[e, k], win(b, neg if y else pos, y) - win(a, neg if y else pos, y), abs_tol=1e-9)
    assert ranking.wasserstein(spark.createDataFrame([(0, 1.0), (1, 3.0)], "g int, v double"), "v", "g") == 2.0


def test_samples_are_finished_in_every_mode(spark, events):
    from chronoweft.operators import finalise

    past, late = events.where("ts < 190"), events.where("ts >= 190")
    q = tables.queries(events, late, 2).drop("_size")
    names = {f"{s.name}_{c}" for s in finalise.PROMPT_SIGNALS for c in ("level", "pct")}
    for mode, reference, expert in (("sequential", "contextual", "global"), ("train_pool", "sequential", "fixed")):
        got = finalise.finalise_samples(events, q, mode=mode, reference=reference, expert=expert, pools=2, pool_size=6)
        rows = got.collect()
        assert len(rows) == q.count() and names <= set(got.columns) and {r["expert"] for r in rows} <= {"Yes", "No"}
        assert {r["structural"] for r in rows} <= {"Low", "Modest", "High"} and all(r["rrf"] > 0 for r in rows)
    # the mean over pools of the fused ranks of the anchor
    from chronoweft.operators.sampling import training_pools

    columns = ["recency", "popularity"]
    fused = {(r["eid"], r["k"]): r["rrf"] for r in finalise.pool_fusion(past, q, columns, 2, 6).collect()}
    assert set(fused) == {(r["eid"], r["k"]) for r in q.collect()}
    one = q.where("k = 1")
    pools = training_pools(one.withColumn("eid", F.col("eid") * 4096 + 1), past.select(F.col("i").alias("node")), 2, 6)
    asked = pools.select((F.col("eid") * 2 + F.col("pool")).alias("eid"), F.col("place").alias("k"), "src", F.col("target").alias("tgt"), "t")
    seen: dict = {}
    for r in registry.scores(past, asked, columns).collect():
        seen.setdefault(r["eid"], []).append(r)
    want: dict = {}
    for e, rows in seen.items():
        assert len(rows) == 6
        rank = lambda c: sorted(rows, key=lambda r: (-r[c], r["k"])).index(next(r for r in rows if r["k"] == 0)) + 1  # noqa: B023, E731
        want.setdefault(e // 2 // 4096, []).append(sum(1 / (60 + rank(c)) for c in columns))
    for e, parts in want.items():
        assert len(parts) == 2 and math.isclose(fused[e, 1], sum(parts) / 2)
    with pytest.raises(ValueError):
        finalise.learned_top(q, q.limit(1).withColumn("priority", F.lit(1.0)), 0.1)
    assert finalise.learned_top(q, q.limit(1).withColumn("priority", F.lit(1.0)), 0.1, default=0.0).count() == round(0.1 * q.count())


def test_contextual_levels_are_not_changed_by_reverse_events(spark):
    from chronoweft.operators.calibration import contextual_calibration
    from chronoweft.plans.calibration import signal_rows

    rows = [(0, 1, 0, 2, 1), (1, 1, 1, 3, 2), (2, 1, 2, 3, 3), (3, 2, 3, 1, 4), (4, 4, 4, 1, 5)]
    q = spark.createDataFrame([(n, 0, 1, n, 10) for n in (2, 3, 4)], "eid long, k int, src long, tgt long, t long")
    got = {}
    for name, kept in (("both", rows), ("out", rows[:3])):
        events = spark.createDataFrame([(*r, 1) for r in kept], EVENTS)
        got[name] = {r["eid"]: (r["past"], r["past_level"], r["past_pct"]) for r in contextual_calibration(events, signal_rows(events, q)).collect()}
    assert got["both"] == got["out"] == {2: (1, "Low", 0.0), 3: (2, "High", 100.0), 4: (0, "Low", 0.0)}


def test_few_shot_blocks_and_summaries(spark):
    one = lambda f, text: spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    text = "intro\n## Example 1 (short)\n```text\nQ: a\nA: b\n```\nID 2\n\n  plain block \nExample 3\n\n"
    assert one(T.few_shot_blocks, text) == ["Q: a\nA: b", "plain block"]
    assert one(T.few_shot_blocks, " no header ") == ["no header"] and one(T.few_shot_blocks, None) == [] and one(T.few_shot_blocks, "  ") == []
    long = "A film about a long walk through the hills of a country that nobody knows. Side 2 holds extras. It ends well! Bonus features include a tour"
    assert one(T.summarise, long) == "A film about a long walk through the hills of a country that nobody knows. It ends well!"
    assert one(T.summarise, "Disc 1 of 3. Track: one") == "Disc 1 of 3. Track: one" and one(T.summarise, "") == ""
    assert one(T.summarise, "word " * 70 + "end") == ("word " * 55).strip() + "..."


def test_long_text_functions_work_out_their_argument_once(spark):
    """A text that is named at many places would be normalised at each of them, within loops even for every mark of every sentence."""
    rows = spark.createDataFrame([("Name: x. Track: y",)], "told string")
    normal = T.normalise_space(F.col("told"))
    for made in (T.summarise(normal), T.labelled_fields(F.col("told"), ["Name", "Track"]), T.city_zip(F.col("told")), T.dedupe(F.split(normal, ",")), T.shorten(F.col("told"), 5), T.shorten_words(F.col("told"), 2)):
        plan = rows.select(made.alias("made"))._jdf.queryExecution().analyzed().toString().splitlines()[0]
        assert plan.count("told#") == 1, plan


def test_draws_of_all_batches_are_not_broadcast(spark, monkeypatch):
    events = spark.createDataFrame([(n, n % 7, 10 + n % 11, float(n // 8)) for n in range(160)], "eid long, u long, i long, ts double").selectExpr("*", "0L as r")
    plans, kept = {}, sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    sampling.batch_negatives(events, events.where("ts > 10").selectExpr("eid", "u AS src", "ts AS t"), 16)
    assert "SortMergeJoin [idx" in plans["drawn-pairs"]


def test_popularity_of_both_ends_takes_one_run_over_the_events(spark, monkeypatch):
    from chronoweft.operators import scorers

    events = spark.createDataFrame([(0, 1, 3, 1.0), (1, 1, 3, 2.0), (2, 2, 3, 1.0)], "eid long, u long, i long, ts double").selectExpr("*", "0L as r")
    q = spark.createDataFrame([(9, 0, 1, 3, 2.0), (9, 1, 2, 7, 3.0)], "eid long, k int, src long, tgt long, t double")
    runs, once = [], scorers.asof_aggregate
    monkeypatch.setattr(scorers, "asof_aggregate", lambda *a, **o: (runs.append(1), once(*a, **o))[1])
    assert {r["k"]: r["popularity"] for r in scorers.popularity(events, q, "sum").collect()} == {0: 3, 1: 1} and len(runs) == 1
    got = {r["k"]: (r["src_n"], r["tgt_n"], round(r["tgt_decayed"], 6)) for r in scorers.end_degrees(events, q, ["src", "tgt"], 1.0, 2).collect()}
    assert got == {0: (1, 2, round(2 * math.exp(-1), 6)), 1: (1, 0, 0.0)} and len(runs) == 2


def test_histories_are_added_without_a_join_by_query(spark):
    events = spark.createDataFrame([(0, 1, 3, 1.0), (1, 3, 1, 2.0), (2, 2, 2, 1.0), (3, 2, 3, 2.0)], "eid long, u long, i long, ts double").selectExpr("*", "0L as r")
    q = spark.createDataFrame([(9, 0, 1, 3, 3.0), (9, 1, 2, 2, 2.0), (9, 2, 1, 7, 2.0)], "eid long, k int, src long, tgt long, t double")
    out = registry.scores(events, q, ["recency", "past", "popularity", "global_recency"])
    assert {r["k"]: tuple(r)[5:] for r in out.collect()} == {0: (-1.0, 2, 3, -1.0), 1: (-1.0, 2, 2, -1.0), 2: (-1e15, 0, 0, -1e15)}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 2 and not any("eid" in line for line in joins)


def test_fusion_places_all_scorers_by_one_population(spark, monkeypatch):
    from chronoweft.operators import calibration, finalise

    rows = spark.createDataFrame([(n, 0, n // 3, float(n % 4), -1e15 if n % 2 else float(-n)) for n in range(30)], "eid long, k int, t long, a double, b double")
    made, names, population, kept = [], [], calibration.Population, finalise.written
    monkeypatch.setattr(calibration, "Population", lambda *a, **o: (made.append(1), population(*a, **o))[1])
    monkeypatch.setattr(finalise, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    got = finalise.sequential_fusion(rows, ["a", "b"], 16).collect()
    assert len(made) == 1 and names == ["shares"] and len(got) == 30
    data = [r.asDict() for r in got]
    for r in data:
        for c in ("a", "b"):
            earlier = [x[c] for x in data if x["t"] < r["t"]]
            want = math.floor((1 - sum(x <= r[c] for x in earlier) / len(earlier)) * 15 + 0.5) + 1 if earlier else 8
            assert r[f"{c}_rank"] == want


def test_calibrated_rows_are_not_taken_apart(spark):
    """A row's signals are looked up by its own values: no row for each signal that a grouping by query puts together again."""
    from chronoweft.operators.calibration import Signal, sequential_calibration

    rows = spark.createDataFrame([(n, n % 2, n // 4, float(n % 5), None if n % 3 else n) for n in range(40)], "eid long, k int, t long, a double, b long")
    out = sequential_calibration(rows, [Signal("a", pool="p"), Signal("b", False, "None", "p")])
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("eid" in line for line in plan if "Aggregate" in line or "Join" in line)
    got = out.collect()
    assert len(got) == 40 and {r["b_level"] for r in got if r["b"] is None} == {"None"} and {r["b_pct"] for r in got if r["b"] is None} == {0.0}


def test_contextual_rows_are_not_taken_apart(spark):
    from chronoweft.operators.calibration import contextual_calibration
    from chronoweft.plans.calibration import signal_rows

    events = spark.createDataFrame([(n, 1 + n % 3, 0, 10 + n % 5, n, 1) for n in range(40)], EVENTS)
    q = spark.createDataFrame([(n, 0, 1 + n % 4, 10 + n % 6, 5 * n) for n in range(9)], "eid long, k int, src long, tgt long, t long")
    out = contextual_calibration(events, signal_rows(events, q))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("eid" in line for line in plan if "Aggregate" in line or "Join" in line)
    got = {r["eid"]: r for r in out.collect()}
    assert len(got) == 9
    for n, r in got.items():
        counts: dict = {}
        for e in range(min(40, 5 * n)):
            if 1 + e % 3 == r["src"]:
                counts[10 + e % 5] = counts.get(10 + e % 5, 0) + 1
        v, every = counts.get(r["tgt"], 0), list(counts.values())
        below, upto = sum(x < v for x in every), sum(x <= v for x in every)
        want = max(0, min(100, 100 * ((below + upto - 1) / 2) / (len(every) - 1))) if len(every) > 1 else 50.0
        assert r["past"] == v and math.isclose(r["past_pct"], want)
