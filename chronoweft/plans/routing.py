"""Registered queries of routing, alignment, merging, thresholds, calibration and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import alignment as I
from chronoweft.operators import ranking as R
from chronoweft.operators import registry
from chronoweft.operators import routing as G
from chronoweft.operators import splits as P
from chronoweft.plans.reference import _BATCH, _EDGES, _FUSED, _graph, _in_batches, _rounded, draw_sql, fused, query, scored
from chronoweft.sources import tables as D
from chronoweft.sources.written import written

_AUC = "round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6)"
_AP = "round(sum(p * tp / (tp + fp)) / sum(p), 6)"
_BASE = f"{_EDGES}, {_FUSED}"


def _curve(rows: str, score: str, name: str) -> str:
    return f"{name}_s AS (SELECT {score} AS s, sum(label) AS p, sum(1 - label) AS n FROM {rows} GROUP BY 1), {name} AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM {name}_s)"


def _best(rows: str = "fused", score: str = "popularity") -> str:
    return f"{_curve(rows, score, 'bc')}, best AS (SELECT s AS threshold, round((tp / sum(p) OVER () + 1 - fp / sum(n) OVER ()) / 2, 9) AS b FROM bc ORDER BY b DESC, s LIMIT 1)"


@query(f"WITH {_BASE} SELECT eid, k, round((rrf - min(rrf) OVER ()) / (max(rrf) OVER () - min(rrf) OVER ()), 6) AS scaled FROM fused")
def minmax_scores(spark, d):
    return _rounded(G.minmax_scores(fused(spark, d), "rrf", "scaled").select("eid", "k", "scaled"), "scaled")


@query(f"WITH {_BASE} SELECT eid, k FROM fused ORDER BY {draw_sql('eid', 'k', '2147483647')}, eid, k LIMIT (SELECT CAST(greatest(1, round_even(0.1 * count(*), 0)) AS BIGINT) FROM fused)")
def random_budget(spark, d):
    return G.random_budget(written(_graph(spark, d)[1], "queries"), 0.1).select("eid", "k")


@query(f"""WITH {_BASE}, c AS (SELECT eid, k, popularity, round(ra, 6) AS ra, row_number() OVER (ORDER BY popularity DESC, eid, k) AS n FROM fused), s AS (SELECT * FROM c WHERE n > 40 AND n <= 200 ORDER BY ra DESC, eid, k LIMIT 60)
SELECT eid, k, 'core' AS part FROM c WHERE n <= 40 UNION ALL SELECT eid, k, 'shell' FROM s""")
def core_and_shell(spark, d):
    return G.core_and_shell(_rounded(scored(spark, d, "popularity", "ra"), "ra"), "popularity", "ra", 100, 40, 200).select("eid", "k", "part")


@query(f"WITH {_BASE} SELECT eid, k, popularity FROM fused WHERE popularity >= 20 AND popularity < 40")
def threshold_band(spark, d):
    return G.threshold_band(scored(spark, d, "popularity"), "popularity", 20, 40).select("eid", "k", "popularity")


@query(f"""WITH {_BASE}, {_best()}, n AS (SELECT CAST(greatest(1, round_even(0.2 * count(*), 0)) AS BIGINT) AS n FROM fused),
c AS (SELECT popularity AS s, label, row_number() OVER (ORDER BY abs(popularity - threshold), eid, k) AS place FROM fused, best), b AS (SELECT min(s) AS lo, max(s) AS hi FROM c, n WHERE place <= n)
SELECT CAST((SELECT threshold FROM best) AS DOUBLE) AS center, CAST(lo AS DOUBLE) AS low, round(CAST(hi AS DOUBLE), 6) AS high, (SELECT n FROM n) AS requested, count(*) FILTER (s >= lo AND s <= hi) AS selected, round(avg(label) FILTER (s >= lo AND s <= hi), 6) AS positive_rate FROM c, b GROUP BY ALL""")
def uncertainty_band(spark, d):
    return _rounded(G.uncertainty_band(scored(spark, d, "popularity"), "popularity", "label", 0.2), "high", "positive_rate")


@query(f"""WITH {_BASE}, b AS (SELECT quantile_cont(popularity, 0.3) FILTER (label = 0) AS low, quantile_cont(popularity, 0.7) FILTER (label = 1) AS high FROM fused)
SELECT low, high, FALSE AS collapsed, round(avg(CAST(popularity < low AS INTEGER)), 6) AS low_coverage, round(avg(CAST(popularity >= low AND popularity < high AS INTEGER)), 6) AS middle_coverage, round(avg(CAST(popularity >= high AS INTEGER)), 6) AS high_coverage,
round(avg(1 - label) FILTER (popularity < low), 6) AS low_negative_rate, round(avg(label) FILTER (popularity >= high), 6) AS high_positive_rate FROM fused, b GROUP BY low, high""")
def three_way_thresholds(spark, d):
    return _rounded(G.three_way_report(scored(spark, d, "popularity"), "popularity", "label", 0.3, 0.7), "low_coverage", "middle_coverage", "high_coverage", "low_negative_rate", "high_positive_rate")


@query(f"""WITH {_BASE}, {_best()} SELECT threshold, round(avg(CAST(popularity >= threshold AS INTEGER)) FILTER (label = 1), 6) AS tpr, round(avg(CAST(popularity < threshold AS INTEGER)) FILTER (label = 0), 6) AS tnr,
round((avg(CAST(popularity >= threshold AS INTEGER)) FILTER (label = 1) + avg(CAST(popularity < threshold AS INTEGER)) FILTER (label = 0)) / 2, 6) AS balanced_accuracy, round(avg(CAST(popularity >= threshold AS INTEGER)), 6) AS positive_rate FROM fused, best GROUP BY threshold""")
def binary_threshold(spark, d):
    return _rounded(G.binary_report(scored(spark, d, "popularity"), "popularity", "label"), "tpr", "tnr", "balanced_accuracy", "positive_rate")


@query(None)
def mixture_overlap(spark, d):
    """Two components of the popularity, and the rows between them."""
    rows = scored(spark, d, "popularity")
    fit = G.mixture(rows, "popularity")
    return _rounded(rows.select("eid", "k", G.overlap(F.col("popularity"), fit).alias("overlap")), "overlap")


@query(f"""WITH {_BASE}, x AS (SELECT eid, k, rank() OVER (ORDER BY popularity) - 1 AS lt, rank() OVER (ORDER BY popularity) - 1 + count(*) OVER (PARTITION BY popularity) AS le, count(*) OVER () AS n FROM fused),
v AS (SELECT past AS v, row_number() OVER (ORDER BY past) - 1 AS place, count(*) OVER () AS m FROM fused WHERE k = 0), p AS (SELECT eid, k, (lt + le - 1) / 2 / (n - 1) * ((SELECT count(*) FROM v) - 1) AS place FROM x)
SELECT eid, k, round(CAST(a.v + (b.v - a.v) * (p.place - floor(p.place)) AS DOUBLE), 6) AS aligned FROM p JOIN v a ON a.place = floor(p.place) JOIN v b ON b.place = least(floor(p.place) + 1, b.m - 1)""")
def quantile_alignment(spark, d):
    """Popularity put on the scale of the positives' past interactions."""
    rows = scored(spark, d, "popularity", "past")
    return _rounded(G.align_by_quantile(rows.select("eid", "k", "popularity"), "popularity", rows.where("k = 0"), "past", "aligned").select("eid", "k", "aligned"), "aligned")


@query(f"""WITH RECURSIVE {_BASE}, p AS (SELECT popularity AS x, CAST(count(*) AS DOUBLE) AS w, CAST(sum(label) AS DOUBLE) AS s FROM fused GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY x) AS uw, sum(s) OVER (ORDER BY x) AS us FROM p),
f AS (SELECT x, max(low) AS v FROM (SELECT b.x, a.x AS a, min((z.us - a.us + a.s) / (z.uw - a.uw + a.w)) AS low FROM c b JOIN c a ON a.x <= b.x JOIN c z ON z.x >= b.x GROUP BY ALL) GROUP BY x)
SELECT eid, k, popularity, round(v, 6) AS aligned FROM fused JOIN f ON f.x = popularity""".replace("WITH RECURSIVE", "WITH"))
def isotonic_alignment(spark, d):
    """The largest of the least means of stretches about a value, which pooling reaches, at every value's own fit."""
    rows = scored(spark, d, "popularity")
    return _rounded(I.apply_isotonic(rows, "popularity", I.fit_isotonic(rows, "popularity", "label"), "aligned").select("eid", "k", "popularity", "aligned"), "aligned")


@query(f"""WITH {_BASE}, {_BATCH}, f AS (SELECT eid, k, batch, popularity, round(ra, 9) AS ra FROM fused JOIN bat USING (eid)), a AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ra DESC, eid, k) AS n FROM f), b AS (SELECT batch, popularity AS grafted, row_number() OVER (PARTITION BY batch ORDER BY popularity DESC, eid, k) AS n FROM f)
SELECT eid, k, grafted FROM a JOIN b USING (batch, n)""")
def rank_graft(spark, d):
    return G.rank_graft(_in_batches(_rounded(scored(spark, d, "popularity", "ra"), "ra", digits=9)), "popularity", "ra", "grafted", ["batch"]).select("eid", "k", "grafted")


@query(f"WITH {_BASE} SELECT eid, k, round(CASE WHEN past > 0 THEN 0.25 * past + 0.75 * popularity ELSE popularity END, 6) AS merged FROM fused")
def alpha_merge(spark, d):
    rows = scored(spark, d, "popularity", "past").withColumn("other", F.when(F.col("past") > 0, F.col("past")))
    return _rounded(G.merge(rows, "popularity", "other", 0.25, "merged").select("eid", "k", "merged"), "merged")


@query(f"WITH {_BASE}, firsts AS (SELECT * FROM fused WHERE k <= 1), {_curve('firsts', 'popularity', 'c')} SELECT {_AUC} AS auc, {_AP} AS ap FROM c")
def one_vs_one_metrics(spark, d):
    return _rounded(G.one_vs_one(scored(spark, d, "popularity"), "popularity"), "auc", "ap")


@query(f"""WITH {_BASE}, firsts AS (SELECT * FROM fused WHERE k <= 1), {_curve('firsts', 'popularity', 'c')}, {_curve('fused', 'popularity', 'g')}
SELECT (SELECT {_AUC} FROM c) AS auc, (SELECT {_AP} FROM c) AS ap, (SELECT {_AUC} FROM g) AS auc_global, (SELECT {_AP} FROM g) AS ap_global, round(avg(CAST(CAST(popularity > 0.5 AS INTEGER) = label AS INTEGER)), 6) AS accuracy, count(*) AS samples, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives FROM fused""")
def metric_report(spark, d):
    return _rounded(G.metric_report(scored(spark, d, "popularity"), "popularity"), "auc", "ap", "auc_global", "ap_global", "accuracy")


@query(f"""WITH {_BASE}, e AS (SELECT quantile_cont(t, [0, 0.25, 0.5, 0.75, 1]) AS e FROM fused WHERE k = 0), p AS (SELECT f.*, CASE WHEN t < e[2] THEN 1 WHEN t < e[3] THEN 2 WHEN t < e[4] THEN 3 ELSE 4 END AS bucket FROM fused f, e),
r AS (SELECT bucket, count(*) AS queries, round(avg(1 / (1 + ge)), 6) AS mrr FROM (SELECT a.bucket, a.eid, count(b.eid) AS ge FROM p a LEFT JOIN p b ON b.eid = a.eid AND b.k > 0 AND b.popularity >= a.popularity WHERE a.k = 0 GROUP BY ALL) GROUP BY bucket),
s AS (SELECT bucket, popularity AS s, sum(label) AS p, sum(1 - label) AS n FROM p GROUP BY ALL), c AS (SELECT *, sum(p) OVER (PARTITION BY bucket ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY bucket ORDER BY s DESC) AS fp FROM s)
SELECT bucket, any_value(queries) AS queries, any_value(mrr) AS mrr, {_AUC} AS auc, {_AP} AS ap FROM c JOIN r USING (bucket) GROUP BY bucket""")
def time_bucket_metrics(spark, d):
    return _rounded(G.time_buckets(scored(spark, d, "popularity"), "popularity", 4), "mrr", "auc", "ap")


@query(f"""WITH {_BASE}, f AS (SELECT eid, k, label, popularity AS b, popularity + past AS o FROM fused), pos AS (SELECT b AS s, count(*) AS c FROM f WHERE label = 1 GROUP BY 1), neg AS (SELECT b AS s, count(*) AS c FROM f WHERE label = 0 GROUP BY 1),
v AS (SELECT DISTINCT s FROM (SELECT b AS s FROM f UNION ALL SELECT o FROM f)),
w AS (SELECT v.s, (SELECT sum(CASE WHEN neg.s < v.s THEN c WHEN neg.s = v.s THEN c / 2 ELSE 0 END) / sum(c) FROM neg) AS above, (SELECT sum(CASE WHEN pos.s > v.s THEN c WHEN pos.s = v.s THEN c / 2 ELSE 0 END) / sum(c) FROM pos) AS below FROM v)
SELECT eid, k, round(CASE WHEN label = 1 THEN y.above - x.above ELSE y.below - x.below END, 6) AS utility FROM f JOIN w x ON x.s = b JOIN w y ON y.s = o""")
def marginal_utility(spark, d):
    rows = scored(spark, d, "popularity", "past").withColumn("other", F.col("popularity") + F.col("past"))
    return _rounded(G.marginal_utility(rows, "popularity", "other").select("eid", "k", "utility"), "utility")


@query(f"""WITH {_BASE}, c AS (SELECT quantile_cont(popularity, 0.3) AS lo, quantile_cont(popularity, 0.7) AS hi FROM fused), l AS (SELECT label, CASE WHEN lo = hi THEN 'Modest' WHEN popularity >= hi THEN 'High' WHEN popularity <= lo THEN 'Low' ELSE 'Modest' END AS level FROM fused, c)
SELECT level, count(*) AS n, round(avg(label), 6) AS positive_rate, round(count(*) / (SELECT count(*) FROM l), 6) AS coverage FROM l GROUP BY level""")
def level_table(spark, d):
    return _rounded(G.level_table(R.level_buckets(scored(spark, d, "popularity"), "popularity"), "level", "label"), "positive_rate", "coverage")


@query(f"""WITH {_BASE}, h AS (SELECT label, popularity, popularity + 10 * past AS o FROM fused), {_curve('h', 'popularity', 'a')}, {_curve('h', 'o', 'b')}, r AS (SELECT (SELECT {_AUC} FROM a) AS base_auc, (SELECT {_AP} FROM a) AS base_ap, (SELECT {_AUC} FROM b) AS auc, (SELECT {_AP} FROM b) AS ap)
SELECT *, round(auc - base_auc, 5) AS auc_change, round(ap - base_ap, 5) AS ap_change FROM r""")
def policy_change(spark, d):
    rows = written(scored(spark, d, "popularity", "past").select("label", "popularity", (F.col("popularity") + 10 * F.col("past")).alias("other")), "policies")
    out = _rounded(G.policy_change(rows, "popularity", "other"), "base_auc", "base_ap", "auc", "ap")
    return _rounded(out.withColumns({"auc_change": F.col("auc") - F.col("base_auc"), "ap_change": F.col("ap") - F.col("base_ap")}), "auc_change", "ap_change", digits=5)


_EARLIER = "tt AS (SELECT DISTINCT t FROM fused)"


@query(f"""WITH {_BASE}, {_EARLIER}, c AS (SELECT tt.t, quantile_cont(f.popularity, 0.3) AS lo, quantile_cont(f.popularity, 0.7) AS hi FROM tt JOIN fused f ON f.t < tt.t GROUP BY tt.t)
SELECT eid, k, CASE WHEN lo IS NULL OR lo = hi THEN 'Modest' WHEN popularity >= hi THEN 'High' WHEN popularity <= lo THEN 'Low' ELSE 'Modest' END AS level FROM fused LEFT JOIN c USING (t)""")
def sequential_levels(spark, d):
    return G.sequential_levels(scored(spark, d, "popularity"), "popularity").select("eid", "k", "level")


@query(f"""WITH {_BASE}, ve AS (SELECT eid, u AS src, i, ts AS t FROM edges, cuts WHERE ts > val_time AND ts <= test_time),
vq AS (SELECT eid, 0 AS k, i AS tgt, t FROM ve UNION ALL SELECT eid, k, node, t FROM (SELECT eid, k, t, {draw_sql("eid", "k", "SELECT count(*) FROM pool")} AS idx FROM ve, (SELECT unnest([1, 2, 3]) AS k)) JOIN pool USING (idx)),
vp AS (SELECT eid, k, count(ts) AS popularity FROM vq LEFT JOIN adj ON node = tgt AND ts < t GROUP BY ALL), c AS (SELECT quantile_cont(popularity, 0.3) AS lo, quantile_cont(popularity, 0.7) AS hi FROM vp)
SELECT eid, k, CASE WHEN lo = hi THEN 'Modest' WHEN popularity >= hi THEN 'High' WHEN popularity <= lo THEN 'Low' ELSE 'Modest' END AS level FROM fused, c""")
def frozen_levels(spark, d):
    """Levels of the test queries by bounds that the validation queries gave."""
    events = written(D.edges(spark, d), "events")
    val_time, test_time = P.boundaries(events)
    # the queries of both splits in one run: a target's events are met once
    asked = written(D.queries(events, events.where(F.col("ts") > val_time)), "queries")
    rows = written(registry.scores(events, asked, ["popularity"]), "scored")
    return G.frozen_levels(rows.where(F.col("t") > test_time), rows.where(F.col("t") <= test_time), "popularity").select("eid", "k", "level")


@query(f"""WITH {_BASE}, {_EARLIER}, c AS (SELECT tt.t, quantile_cont(f.popularity, 0.5) AS m FROM tt JOIN fused f ON f.t < tt.t GROUP BY tt.t), g AS (SELECT quantile_cont(popularity, 0.5) AS g FROM fused)
SELECT eid, k, CASE WHEN popularity >= g THEN 'Yes' ELSE 'No' END AS expert, CASE WHEN m IS NULL THEN 'Unknown' WHEN popularity >= m THEN 'Yes' ELSE 'No' END AS running FROM fused LEFT JOIN c USING (t), g""")
def expert_labels(spark, d):
    rows = G.expert_labels(scored(spark, d, "popularity"), "popularity")
    running = G.expert_labels(rows.withColumnRenamed("expert", "overall"), "popularity", "running")
    return running.select("eid", "k", F.col("overall").alias("expert"), F.col("expert").alias("running"))


@query(f"""WITH {_BASE}, {_EARLIER}, x AS (SELECT DISTINCT t, popularity FROM fused), s AS (SELECT x.t, x.popularity, count(*) FILTER (f.popularity <= x.popularity) / count(*) AS share FROM x JOIN fused f ON f.t < x.t GROUP BY ALL)
SELECT eid, k, CAST(CASE WHEN share IS NULL THEN 50 ELSE floor((1 - share) * 99 + 0.5) + 1 END AS BIGINT) AS pseudo_rank FROM fused LEFT JOIN s USING (t, popularity)""")
def sequential_pseudo_rank(spark, d):
    return G.sequential_pseudo_rank(scored(spark, d, "popularity"), "popularity", 100).select("eid", "k", "pseudo_rank")


@query(f"""WITH {_BASE}, {_BATCH}, f AS (SELECT eid, k, t, batch, popularity, past, recency, round(ra, 9) AS ra FROM fused JOIN bat USING (eid) WHERE k <= 1)
SELECT eid, k, round({" + ".join(f"1.0 / (60 + row_number() OVER (PARTITION BY batch ORDER BY {c} DESC, t, eid, k))" for c in ("recency", "popularity", "past", "ra"))}, 9) AS rrf FROM f""")
def fuse_in_batches(spark, d):
    return _rounded(G.fuse_in_batches(_in_batches(_rounded(fused(spark, d), "ra", digits=9)), ["recency", "popularity", "past", "ra"], "batch").select("eid", "k", "rrf"), "rrf", digits=9)


@query(f"""WITH {_BASE}, g AS (SELECT eid, k, abs(popularity - 30) AS gap, row_number() OVER (ORDER BY abs(popularity - 30), eid, k) AS n, CAST(greatest(1, round_even(0.15 * count(*) OVER (), 0)) AS BIGINT) AS m FROM fused) SELECT eid, k, n <= m AS routed, CAST(CASE WHEN n <= m THEN gap END AS DOUBLE) AS diagnostic FROM g""")
def support_rows(spark, d):
    return G.support_rows(scored(spark, d, "popularity"), "popularity", 30.0, 0.15).select("eid", "k", "routed", F.col("diagnostic").cast("double").alias("diagnostic"))


@query(None)
def out_of_fold_scores(spark, d):
    """Labels predicted from four scorers, each query by a fit that has not seen it."""
    return _rounded(G.out_of_fold(fused(spark, d), ["popularity", "past", "ra", "rrf"], "label", "eid").select("eid", "k", "fold", "predicted"), "predicted")


_HYPER = ["popularity", "past", "ra", "recent_degree"]


def _hyper_sql() -> str:
    side, pairs, m = ("k = 0", "k > 0"), [(i, j) for i in range(4) for j in range(i, 4)], range(4)
    sums = ", ".join(f"sum(CASE WHEN {on} THEN {_HYPER[i]}::DOUBLE * {_HYPER[j]} END) AS s{s}{i}{j}" for s, on in enumerate(side) for i, j in pairs)
    far = lambda s, i, j: f"round(1 - coalesce(s{s}{min(i, j)}{max(i, j)} / nullif(sqrt(s{s}{i}{i} * s{s}{j}{j}), 0), 0), 12)"
    member = ", ".join("CAST(" + " OR ".join(f"coalesce({far(s, i, j)} > 0 AND {far(s, i, j)} < 0.1, FALSE)" for j in m if j != i) + f" AS INTEGER) AS h{s}{i}" for s in (0, 1) for i in m)
    fused = " + ".join(f"(1 + {' + '.join(f'h{s}{i} * h{s}{j}' for s in (0, 1) for i in m)}) * {c}" for j, c in enumerate(_HYPER))
    return f"""WITH {_BASE}, {_BATCH}, rd AS (SELECT eid, k, count(ts) FILTER (ts >= t - 90) AS recent_degree FROM q LEFT JOIN adj ON node = tgt AND ts < t GROUP BY ALL),
f AS (SELECT eid, k, batch, popularity, past, round(ra, 9) AS ra, recent_degree FROM fused JOIN bat USING (eid) JOIN rd USING (eid, k)), s AS (SELECT batch, {sums} FROM f GROUP BY batch), h AS (SELECT batch, {member} FROM s)
SELECT eid, k, round(CAST({fused} AS DOUBLE), 9) AS fused FROM f JOIN h USING (batch)"""


@query(_hyper_sql())
def hyper_fusion(spark, d):
    """Four scorers summed in each batch of 64 queries, weighed by how they agree there."""
    rows = _in_batches(scored(spark, d, *_HYPER))
    return _rounded(G.hyper_fusion(rows, _HYPER, "batch").select("eid", "k", "fused"), "fused", digits=9)


def _views_sql() -> str:
    """Ridge fits of three unknowns by determinants, from the sums of all rows less those of the fold."""
    seeds, x = (0, 1, 2), ("1", "a", "(CASE WHEN on_ THEN b ELSE 0 END)")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    folds = " UNION ALL ".join(f"SELECT *, {s} AS seed, {draw_sql('eid', '0', '5')[:-1].replace('12345', str(12345 + s))}) AS fold FROM v" for s in seeds)
    sums = ", ".join([f"sum({x[i]} * {x[j]})::DOUBLE AS g{i}{j}" for i, j in pairs] + [f"sum({x[i]} * label)::DOUBLE AS r{i}" for i in range(3)])
    rest = ", ".join(f"sum({c}) OVER (PARTITION BY seed) - {c} AS {c}" for c in [f"g{i}{j}" for i, j in pairs] + [f"r{i}" for i in range(3)])
    scaled = ", ".join([f"g{i}{j} / sqrt(greatest(g{i}{i}, 1e-12) * greatest(g{j}{j}, 1e-12)){' + 0.001' if i == j else ''} AS m{i}{j}" for i, j in pairs] + [f"r{i} / sqrt(greatest(g{i}{i}, 1e-12)) AS y{i}, sqrt(greatest(g{i}{i}, 1e-12)) AS z{i}" for i in range(3)])
    a = [["m00", "m01", "m02"], ["m01", "m11", "m12"], ["m02", "m12", "m22"]]
    det = lambda t: f"({t[0][0]} * ({t[1][1]} * {t[2][2]} - {t[1][2]} * {t[2][1]}) - {t[0][1]} * ({t[1][0]} * {t[2][2]} - {t[1][2]} * {t[2][0]}) + {t[0][2]} * ({t[1][0]} * {t[2][1]} - {t[1][1]} * {t[2][0]}))"
    w = ", ".join(f"{det([[f'y{r}' if c == i else a[r][c] for c in range(3)] for r in range(3)])} / {det(a)} / z{i} AS w{i}" for i in range(3))
    return f"""WITH {_BASE}, v AS (SELECT eid, k, label, ln(1 + popularity) AS a, ln(1 + past) AS b, past > 0 AS on_ FROM fused), o AS ({folds}), s AS (SELECT seed, fold, {sums} FROM o GROUP BY ALL), t AS (SELECT seed, fold, {rest} FROM s), m AS (SELECT seed, fold, {scaled} FROM t), w AS (SELECT seed, fold, {w} FROM m)
SELECT eid, k, round(avg(w0 + w1 * a), 6) AS no_call, round(avg(w0 + w1 * a + w2 * b), 6) AS called FROM o JOIN w USING (seed, fold) GROUP BY eid, k"""


@query(_views_sql())
def out_of_fold_views(spark, d):
    """Labels predicted with and without the pair's own history, each query by fits that have not seen it, over three draws of the folds."""
    rows = scored(spark, d, "popularity", "past").withColumns({"a": F.log1p(F.col("popularity").cast("double")), "b": F.log1p(F.col("past").cast("double")), "called_for": F.col("past") > 0})
    return _rounded(G.out_of_fold_views(rows, ["a"], ["b"], "called_for", "label", "eid", (0, 1, 2)).select("eid", "k", "no_call", "called"), "no_call", "called")
