"""Registered queries of the vector operators over time, of feature tables and of text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.operators import history as H
from chronoweft.operators import profiles as V
from chronoweft.operators import registry
from chronoweft.operators import splits as P
from chronoweft.plans.history import _RECENT, _SEQ, _last, _recent, _seq
from chronoweft.plans.reference import _CN, _EDGES, _FUSED, _PAST, _graph, _rounded, _vectors, draw_sql, fused, query
from chronoweft.sources import tables as D
from chronoweft.sources.written import written
from chronoweft.streaming.memory import last_messages
from chronoweft.streaming.memory import memory_bank as bank
from chronoweft.streaming.rolling import rolling_neighbors as near

_UNIT = "unit AS (SELECT vec_id AS node, [CAST(x AS DOUBLE) / sqrt(list_dot_product([CAST(y AS DOUBLE) FOR y IN embedding], [CAST(y AS DOUBLE) FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings)"
_N = "[CAST(x AS DOUBLE) / sqrt(list_dot_product(v, v)) FOR x IN v]"


def _spread(rows: str, keys: str, weight: str, name: str) -> str:
    """Weighted sums of vectors ``v``, scaled to length 1."""
    return f"{name}_d AS (SELECT {keys}, unnest(range(1, 65)) AS dim, unnest(v) AS x, {weight} AS w FROM {rows}), {name}_s AS (SELECT {keys}, dim, sum(w * x) AS x FROM {name}_d GROUP BY ALL), {name} AS (SELECT * REPLACE ({_N} AS v) FROM (SELECT {keys}, list(x ORDER BY dim) AS v FROM {name}_s GROUP BY ALL))"


@query(f"""WITH {_EDGES}, {_UNIT}, p AS (SELECT DISTINCT src, t FROM q), h AS (SELECT src, t, v FROM p JOIN adj ON node = src AND ts < t JOIN unit ON unit.node = nbr), {_spread('h', 'src, t', '1', 'prof')}
SELECT eid, k, round(coalesce(list_dot_product(coalesce(prof.v, own.v), b.v), 0), 6) AS score FROM q LEFT JOIN prof USING (src, t) LEFT JOIN unit own ON own.node = src LEFT JOIN unit b ON b.node = tgt""")
def score_history_profile(spark, d):
    return _rounded(V.history_profile(*_graph(spark, d), _vectors(spark, d)), "score")


@query(f"""WITH {_EDGES}, {_UNIT}, p AS (SELECT * FROM q WHERE k <= 1), h AS (SELECT eid, k, a.v, list_dot_product(a.v, b.v) / 0.2 AS x FROM p JOIN adj ON adj.node = src AND ts < t JOIN unit a ON a.node = nbr JOIN unit b ON b.node = tgt),
e AS (SELECT eid, k, v, exp(x - max(x) OVER (PARTITION BY eid, k)) AS e FROM h), {_spread('e', 'eid, k', 'e', 'prof')}
SELECT p.eid, p.k, round(coalesce(list_dot_product(coalesce(prof.v, own.v), b.v), 0), 6) AS score FROM p LEFT JOIN prof USING (eid, k) LEFT JOIN unit own ON own.node = src LEFT JOIN unit b ON b.node = tgt""")
def score_conditioned_profile(spark, d):
    events, q = _graph(spark, d)
    return _rounded(V.conditioned_profile(events, q.where("k <= 1"), _vectors(spark, d)), "score")


_WINDOW = f"""{_UNIT}, ww AS (SELECT node, nbr, sum(exp(-0.01 * (test_time - ts))) AS w FROM adj, cuts WHERE ts BETWEEN test_time - 200 AND test_time AND node IN (SELECT node FROM unit) AND nbr IN (SELECT node FROM unit) GROUP BY ALL),
wa AS (SELECT node, nbr, sum(w) AS w FROM (SELECT * FROM ww UNION ALL SELECT node, node, 1 FROM unit) GROUP BY ALL), wd AS (SELECT node, greatest(sum(w), 1) AS d FROM wa GROUP BY node), wn AS (SELECT wa.node, wa.nbr, w / sqrt(x.d * y.d) AS w FROM wa JOIN wd x ON x.node = wa.node JOIN wd y ON y.node = wa.nbr),
s1 AS (SELECT wn.node AS n1, dim, sum(w * x) AS x FROM wn JOIN (SELECT node, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM unit) u ON u.node = wn.nbr GROUP BY ALL), m1 AS (SELECT n1, s1.dim, 0.9 * s1.x + 0.1 * u.x AS x FROM s1 JOIN (SELECT node, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM unit) u ON u.node = n1 AND u.dim = s1.dim),
s2 AS (SELECT wn.node AS n2, dim, sum(w * x) AS x FROM wn JOIN m1 ON n1 = wn.nbr GROUP BY ALL), m2 AS (SELECT n2, s2.dim, 0.9 * s2.x + 0.1 * u.x AS x FROM s2 JOIN (SELECT node, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM unit) u ON u.node = n2 AND u.dim = s2.dim),
smooth AS (SELECT node, {_N} AS v FROM (SELECT n2 AS node, list(x ORDER BY dim) AS v FROM m2 GROUP BY n2))"""


def _smooth(spark, d, events):
    return V.smooth_window(events, _vectors(spark, d), P.boundaries(events)[1], 200, steps=2, decay=0.01, residual=0.1)


@query(f"WITH {_EDGES}, {_WINDOW} SELECT node, CAST(dim AS INTEGER) AS dim, CASE WHEN round(x, 6) = 0 THEN 0.0::DOUBLE ELSE round(x, 6) END AS x FROM (SELECT node, unnest(range(64)) AS dim, unnest(v) AS x FROM smooth)")
def window_smoothing(spark, d):
    events = written(D.edges(spark, d), "events")
    return _rounded(_smooth(spark, d, events).select("node", F.posexplode("v").alias("dim", "x")), "x")


def _modes_sql(rows: str, low: str, norm: str, weight: str = "sum(w)") -> str:
    """One smoothing step over ``rows`` (node, nbr, w)."""
    return f"""WITH {_EDGES}, {_UNIT}, wi AS (SELECT e.*, exp(-0.01 * (test_time - ts)) AS w FROM edges e, cuts WHERE ts BETWEEN test_time - 200 AND test_time AND u IN (SELECT node FROM unit) AND i IN (SELECT node FROM unit)),
rows AS ({rows}), p0 AS (SELECT node, nbr, sum(w) AS w FROM rows GROUP BY ALL), p1 AS (SELECT p0.node, p0.nbr, {low} AS w FROM p0 JOIN unit a ON a.node = p0.node JOIN unit b ON b.node = p0.nbr),
p AS (SELECT node, nbr, {weight} AS w FROM (SELECT * FROM p1 UNION ALL SELECT node, node, 1.0 FROM unit) WHERE w > 0 GROUP BY ALL), g AS (SELECT node, greatest(sum(w), 1) AS d FROM p GROUP BY node),
n AS (SELECT p.node, p.nbr, p.w / {norm} AS w FROM p JOIN g x ON x.node = p.node JOIN g y ON y.node = p.nbr), h AS (SELECT n.node, unit.v, n.w FROM n JOIN unit ON unit.node = n.nbr), {_spread('h', 'node', 'w', 'sm')}
SELECT node, CAST(dim AS INTEGER) AS dim, CASE WHEN round(x, 6) = 0 THEN 0.0::DOUBLE ELSE round(x, 6) END AS x FROM (SELECT node, unnest(range(64)) AS dim, unnest(v) AS x FROM sm)"""


def _one_step(spark, d, **choice):
    events = written(D.edges(spark, d), "events")
    out = V.smooth_window(events, _vectors(spark, d), P.boundaries(events)[1], 200, decay=0.01, **choice)
    return _rounded(out.select("node", F.posexplode("v").alias("dim", "x")), "x")


_LATEST = "row_number() OVER (PARTITION BY {} ORDER BY ts DESC, eid DESC)"
_KEPT = f"SELECT * FROM wi QUALIFY {_LATEST.format('u')} <= 2 OR {_LATEST.format('i')} <= 2"


@query(_modes_sql(f"SELECT u AS node, i AS nbr, w FROM ({_KEPT}) UNION ALL SELECT i, u, w FROM ({_KEPT})", "CASE WHEN round(list_dot_product(a.v, b.v), 9) < 0.1 THEN 0.5 * p0.w ELSE p0.w END", "sqrt(x.d * y.d)"))
def smoothing_latest_of_both(spark, d):
    """Events among the last two of their source or of their target; pairs of little likeness weigh half."""
    return _one_step(spark, d, top=2, mode="union", cover=True, least=0.1, keep=0.5)


@query(_modes_sql(f"SELECT node, nbr, w FROM (SELECT *, {_LATEST.format('node').replace('eid DESC', 'eid DESC, role DESC')} AS n FROM (SELECT u AS node, i AS nbr, ts, eid, w, 'out' AS role FROM wi UNION ALL SELECT i, u, ts, eid, w, 'in' FROM wi)) WHERE n <= 3", "CASE WHEN round(list_dot_product(a.v, b.v), 9) < 0 THEN 0 ELSE p0.w END", "x.d", "ln(1 + sum(w))"))
def smoothing_latest_of_node(spark, d):
    """Each node's own last three events, pairs of opposed vectors left out, weights dampened, rows scaled by their sums."""
    return _one_step(spark, d, top=3, mode="per_node", least=0.0, keep=0.0, symmetric=False, dampen=True)


@query(f"""WITH {_EDGES}, {_WINDOW}, mx AS (SELECT node, {_N} AS v FROM (SELECT u.node, [0.3 * u.v[j] + 0.7 * s.v[j] FOR j IN range(1, 65)] AS v FROM unit u JOIN smooth s USING (node))), my AS (SELECT node, {_N} AS v FROM (SELECT u.node, [0.8 * u.v[j] + 0.2 * s.v[j] FOR j IN range(1, 65)] AS v FROM unit u JOIN smooth s USING (node)))
SELECT eid, k, round(coalesce(list_dot_product(mx.v, my.v), 0), 6) AS score FROM q LEFT JOIN mx ON mx.node = src LEFT JOIN my ON my.node = tgt""")
def score_asymmetric_blend(spark, d):
    events, q = _graph(spark, d)
    return _rounded(V.blend_scores(q, V.units(_vectors(spark, d)), written(_smooth(spark, d, events), "smooth"), 0.7, 0.2), "score")


@query(f"""WITH {_EDGES}, {_UNIT}, told AS (SELECT node, nbr, ts FROM adj WHERE node IN (SELECT node FROM unit) AND nbr IN (SELECT node FROM unit)), asked AS (SELECT DISTINCT node, t FROM (SELECT src AS node, t FROM q UNION ALL SELECT tgt, t FROM q) SEMI JOIN unit USING (node)),
near AS (SELECT a.node, a.t, nbr, count(*) AS w FROM asked a JOIN told ON told.node = a.node AND ts < t AND ts >= t - 120 GROUP BY ALL UNION ALL SELECT node, t, node, 1 FROM asked), need AS (SELECT DISTINCT node, t FROM (SELECT nbr AS node, t FROM near UNION ALL SELECT node, t FROM asked)),
deg AS (SELECT need.node, need.t, 1 + count(told.ts) AS d FROM need LEFT JOIN told ON told.node = need.node AND ts < t AND ts >= t - 120 GROUP BY ALL), r AS (SELECT near.node, near.t, v, w / sqrt(x.d::DOUBLE * y.d) AS wt FROM near JOIN deg x ON x.node = near.node AND x.t = near.t JOIN deg y ON y.node = near.nbr AND y.t = near.t JOIN unit ON unit.node = near.nbr),
{_spread('r', 'node, t', 'wt', 'sm')} SELECT eid, k, round(coalesce(list_dot_product(a.v, b.v), -1), 6) AS score FROM q LEFT JOIN sm a ON a.node = src AND a.t = q.t LEFT JOIN sm b ON b.node = tgt AND b.t = q.t""")
def score_smoothed_at_time(spark, d):
    events, q = _graph(spark, d)
    return _rounded(V.smoothed_at_time(events, written(q, "queries"), _vectors(spark, d), 120), "score")


@query(f"""WITH {_EDGES}, {_RECENT}, {_UNIT}, h AS (SELECT node, v FROM unit UNION ALL SELECT row, v FROM one JOIN unit ON node = col WHERE row IN (SELECT node FROM unit)), {_spread('h', 'node', '1', 'g')}
SELECT node, CAST(dim AS INTEGER) AS dim, CASE WHEN round(x, 6) = 0 THEN 0.0::DOUBLE ELSE round(x, 6) END AS x FROM (SELECT node, unnest(range(64)) AS dim, unnest(v) AS x FROM g)""")
def propagated_vectors(spark, d):
    return _rounded(V.propagate(_recent(spark, d)[0], _vectors(spark, d)).select("node", F.posexplode("v").alias("dim", "x")), "x")


@query(f"""WITH p AS (SELECT vec_id AS node, unnest(range(64)) AS j, unnest(embedding) AS x FROM embeddings), o AS (SELECT unnest(range(16)) AS dim)
SELECT node, CAST(dim AS INTEGER) AS dim, CASE WHEN round(v, 6) = 0 THEN 0.0::DOUBLE ELSE round(v, 6) END AS x FROM (SELECT node, dim, sum(CAST(x AS DOUBLE) * (1 - 2 * {draw_sql("j", "dim", "2")})) / 4 AS v FROM p, o GROUP BY ALL)""")
def projected_vectors(spark, d):
    return _rounded(V.project(_vectors(spark, d), 16), "x")


@query(f"""WITH {_EDGES}, {_SEQ}, {_UNIT}, p AS (SELECT * FROM q WHERE k = 0), {_last('src', 10, 'h', 'p')}, x AS (SELECT h.eid, h.k, a.v, exp(list_dot_product(a.v, b.v) / 8) AS e FROM h JOIN p USING (eid, k) JOIN unit a ON a.node = h.nbr JOIN unit b ON b.node = src),
d AS (SELECT eid, k, unnest(range(64)) AS dim, unnest(v) AS y, e FROM x), s AS (SELECT eid, k, dim, sum(e * y) / sum(e) AS y FROM d GROUP BY ALL), o AS (SELECT p.eid, p.k, unnest(range(64)) AS dim, unnest(v) AS y FROM p JOIN unit ON unit.node = src)
SELECT o.eid, o.k, CAST(o.dim AS INTEGER) AS dim, CASE WHEN round(coalesce(s.y, o.y), 6) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(s.y, o.y), 6) END AS x FROM o LEFT JOIN s USING (eid, k, dim)""")
def recent_attention(spark, d):
    seq, q = _seq(spark, d)
    return _rounded(V.recent_attention(seq, q.where("k = 0"), _vectors(spark, d), 10).select("eid", "k", F.posexplode("v").alias("dim", "x")), "x")


_FEATURES = ["popularity", "past", "rrf"]


@query(f"""WITH {_EDGES}, {_FUSED}, m AS (SELECT p.popularity - n.popularity AS popularity, p.past - n.past AS past, p.rrf - n.rrf AS rrf FROM fused p JOIN fused n ON n.eid = p.eid AND p.k = 0 AND n.k > 0)
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CAST(sum({a} * {b}) AS DOUBLE), 6) AS g, {f'round(CAST(sum({a}) AS DOUBLE), 6)' if a == b else 'NULL'} AS d FROM m" for a in _FEATURES for b in _FEATURES)}""")
def pair_gram(spark, d):
    return _rounded(V.pair_gram(fused(spark, d), _FEATURES), "g", "d")


def _ridge_sql() -> str:
    """The ridge fit of three features by determinants, from the sums over pairs."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = ", ".join([f"sum({_FEATURES[i]} * {_FEATURES[j]})::DOUBLE AS g{i}{j}" for i, j in pairs] + [f"sum({c})::DOUBLE AS r{i}" for i, c in enumerate(_FEATURES)])
    size = lambda i: f"sqrt(greatest(g{i}{i}, 1e-12))"
    scaled = ", ".join([f"g{i}{j} / ({size(i)} * {size(j)}){' + 1.0' if i == j else ''} AS m{i}{j}" for i, j in pairs] + [f"r{i} / {size(i)} AS y{i}, {size(i)} AS z{i}" for i in range(3)])
    a = [["m00", "m01", "m02"], ["m01", "m11", "m12"], ["m02", "m12", "m22"]]
    det = lambda t: f"({t[0][0]} * ({t[1][1]} * {t[2][2]} - {t[1][2]} * {t[2][1]}) - {t[0][1]} * ({t[1][0]} * {t[2][2]} - {t[1][2]} * {t[2][0]}) + {t[0][2]} * ({t[1][0]} * {t[2][1]} - {t[1][1]} * {t[2][0]}))"
    w = ", ".join(f"{det([[f'y{r}' if c == i else a[r][c] for c in range(3)] for r in range(3)])} / {det(a)} / z{i} AS w{i}" for i in range(3))
    return f"""WITH {_EDGES}, {_FUSED}, m AS (SELECT p.popularity - n.popularity AS popularity, p.past - n.past AS past, p.rrf - n.rrf AS rrf FROM fused p JOIN fused n ON n.eid = p.eid AND p.k = 0 AND n.k > 0),
g AS (SELECT {sums} FROM m), h AS (SELECT {scaled} FROM g), w AS (SELECT {w} FROM h) SELECT eid, k, round({" + ".join(f"w{i} * {c}" for i, c in enumerate(_FEATURES))}, 6) AS score FROM fused, w"""


@query(_ridge_sql())
def pairwise_ridge_scores(spark, d):
    """Queries scored by the weights of a pairwise ridge fit."""
    rows = fused(spark, d)
    w = V.pairwise_ridge(rows, _FEATURES)
    return _rounded(rows.select("eid", "k", sum((F.lit(w[f]) * F.col(f) for f in _FEATURES), F.lit(0.0)).alias("score")), "score")


@query(f"""WITH {_EDGES}, {_CN}, {_PAST}, tp AS (SELECT eid, k, count(ts) AS popularity, coalesce(CAST(max(ts) - any_value(t) AS DOUBLE), -1e15) AS global_recency, count(ts) FILTER (ts >= t - 90) AS recent_degree FROM q LEFT JOIN adj ON node = tgt AND ts < t GROUP BY ALL)
SELECT eid, k, round(-ln(1 + CASE WHEN recency <= -1e14 THEN 1e9 ELSE -recency END), 6) AS recency, round(ln(1 + popularity), 6) AS popularity, round(ln(1 + recent_degree), 6) AS recent_degree, round(-ln(1 + CASE WHEN global_recency <= -1e14 THEN 1e9 ELSE -global_recency END), 6) AS global_recency,
round(ln(1 + past), 6) AS past, round(ra, 6) AS ra FROM scored JOIN past USING (eid, k) JOIN tp USING (eid, k)""")
def feature_matrix(spark, d):
    events, q = _graph(spark, d)
    names = ["recency", "popularity", "recent_degree", "global_recency", "past", "ra"]
    return _rounded(V.log_features(registry.scores(events, written(q, "queries"), names)).select("eid", "k", *names), *names)


_CARD = "'Title: ' || p_name || '. Category: ' || p_type || ', ' || p_brand || ' , ' || lower(p_brand) || '. rank : ' || p_size || '.'"


@query(f"""WITH c AS (SELECT p_partkey, {_CARD} AS card FROM part), f AS (SELECT p_partkey, regexp_extract(card, '(?s)^Title:(.*?)\\. Category:', 1) AS title, regexp_extract(card, 'Category:(.*?)\\. rank :', 1) AS category, regexp_extract(card, 'rank :(.*)$', 1) AS rank FROM c),
s AS (SELECT *, [trim(x, ' .') FOR x IN string_split(category, ',')] AS l FROM f) SELECT p_partkey, trim(title, ' .') AS title, array_to_string([l[j] FOR j IN range(1, len(l) + 1) IF NOT list_contains([lower(y) FOR y IN l[1:j - 1]], lower(l[j]))], '|') AS categories, trim(rank, ' .') AS rank FROM s""")
def text_labelled_fields(spark, d):
    card = F.concat(F.lit("Title: "), "p_name", F.lit(". Category: "), "p_type", F.lit(", "), "p_brand", F.lit(" , "), F.lower("p_brand"), F.lit(". rank : "), "p_size", F.lit("."))
    m = T.labelled_fields(card, ["Title", "Category", "Rank", "Description"])
    fields = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", m.alias("m"))
    m = F.col("m")
    return fields.select("p_partkey", m["title"].alias("title"), F.array_join(T.dedupe(F.split(m["category"], ",")), "|").alias("categories"), m["rank"].alias("rank"))


@query("SELECT c_custkey, 'Lower ' || lower(c_mktsegment) || ', CA' AS city, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(10000 + c_custkey % 80000 AS VARCHAR) END AS zip FROM customer")
def text_city_zip(spark, d):
    tail = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), (10000 + F.col("c_custkey") % 80000).cast("string")))
    card = F.concat(F.lit("Name: "), "c_name", F.lit(", Main St, Old Town, NY 99999, Lower "), F.lower("c_mktsegment"), F.lit(", CA"), tail, F.lit(". Category: x, Elsewhere, TX 11111"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.city_zip(card).alias("c")).select("c_custkey", "c.city", "c.zip")


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN len(string_split(t, ' ')) <= 5 THEN t ELSE rtrim(array_to_string(string_split(t, ' ')[1:5], ' '), ' ,;:-') || '...' END AS words, CASE WHEN length(t) <= 30 THEN t ELSE rtrim(t[1:27]) || '...' END AS chars,
CASE WHEN regexp_matches(lower(t), 'president|minister|governor|official') THEN 'Government Official' WHEN regexp_matches(lower(t), 'government|administration|parliament') THEN 'Government Institution' WHEN regexp_matches(lower(t), 'terrorist|insurgent|militant|rebel') THEN 'Armed Group'
WHEN regexp_matches(lower(t), 'citizen|protester|activist|demonstrator') THEN 'Civilian Actor' WHEN regexp_matches(lower(t), 'country|nation|state|^(egypt|nigeria|israel|america|china)$') THEN 'Nation/Country' ELSE 'Political Actor' END AS kind FROM c WHERE t IS NOT NULL""")
def text_short_and_kind(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    return rows.select("conv_id", "turn", T.shorten_words(F.col("text"), 5).alias("words"), T.shorten(F.col("text"), 30).alias("chars"), T.entity_type(T.normalise_space(F.col("text"))).alias("kind"))


@query("SELECT p_partkey, p_type || ' of ' || p_brand AS meaning, p_name AS plain FROM part")
def text_entity_meaning(spark, d):
    summary = F.concat(F.lit("Summary:  entitymeaning = "), "p_type", F.lit("  of "), "p_brand", F.lit(" ; InteractionSummary= none"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.entity_meaning(summary).alias("meaning"), T.entity_meaning(F.concat(F.lit(" "), "p_name")).alias("plain"))


@query(f"""WITH {_EDGES}, {_SEQ}, p AS (SELECT * FROM q WHERE k = 0), {_last('src', 5, 'h', 'p')}, e AS (SELECT h.eid, age, CASE WHEN role = 'out' THEN h.node ELSE nbr END AS u, CASE WHEN role = 'out' THEN nbr ELSE h.node END AS i, h.ts, src, tgt FROM h JOIN p USING (eid, k)),
s AS (SELECT eid, node, min(pos) AS pos FROM (SELECT eid, u AS node, -2 * age AS pos, src, tgt FROM e UNION ALL SELECT eid, i, -2 * age + 1, src, tgt FROM e) WHERE node <> src AND node <> tgt GROUP BY ALL), n AS (SELECT eid, node, 'N' || row_number() OVER (PARTITION BY eid ORDER BY pos) AS name FROM s),
l AS (SELECT e.eid, age, '- t=' || e.ts || ': ' || (CASE WHEN u = src THEN 'Source' WHEN u = tgt THEN 'Target' ELSE a.name END) || ' --> ' || (CASE WHEN i = src THEN 'Source' WHEN i = tgt THEN 'Target' ELSE b.name END) AS line FROM e LEFT JOIN n a ON a.eid = e.eid AND a.node = u LEFT JOIN n b ON b.eid = e.eid AND b.node = i)
SELECT p.eid, coalesce(string_agg(line, chr(10) ORDER BY age DESC), '- No historical events available') AS history FROM p LEFT JOIN l USING (eid) GROUP BY p.eid""")
def prompt_history(spark, d):
    """The source's last five events as lines with names that hold within the prompt."""
    seq, q = _seq(spark, d)
    q = q.where("k = 0")
    out = F.col("role") == "out"
    rows = H.endpoint_history(seq, q, "src", 5).select("eid", "k", (-F.col("age")).alias("at"), F.when(out, F.col("node")).otherwise(F.col("nbr")).alias("u"), F.when(out, F.col("nbr")).otherwise(F.col("node")).alias("i"), "ts")
    lists = rows.groupBy("eid", "k").agg(F.array_sort(F.collect_list(F.struct("at", "u", "i", "ts"))).alias("events"))
    both = q.join(lists, ["eid", "k"], "left").withColumn("events", F.coalesce("events", F.array().cast(lists.schema["events"].dataType)))
    seen = F.flatten(F.transform("events", lambda e: F.array(e["u"], e["i"])))
    named = both.withColumn("names", T.aliases(F.col("src"), F.col("tgt"), seen))
    return named.select("eid", T.event_lines(F.col("events"), lambda x: F.element_at(F.col("names"), x)).alias("history"))


@query(f"""WITH {_EDGES}, m AS (SELECT q.eid, k, e.ts, e.e_id, row_number() OVER (PARTITION BY q.eid, k ORDER BY e.ts DESC, e.e_id DESC) AS n FROM q JOIN (SELECT eid AS e_id, u, i, ts FROM edges) e ON least(u, i) = least(src, tgt) AND greatest(u, i) = greatest(src, tgt) AND e.ts < t), d AS (SELECT DISTINCT eid, k, ts FROM m WHERE n <= 5),
l AS (SELECT eid, k, string_agg(CAST(ts AS VARCHAR), ', ' ORDER BY ts) AS s FROM d GROUP BY ALL) SELECT eid, k, coalesce('- Previous interaction timestamps (between Source and Target, oldest -> latest):' || chr(10) || '  t=' || s, '- No historical events available') AS line FROM q LEFT JOIN l USING (eid, k)""")
def prompt_mutual_times(spark, d):
    events, q = _graph(spark, d)
    lists = H.mutual_history(events, q, 5).groupBy("eid", "k").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    both = q.join(lists, ["eid", "k"], "left").withColumn("times", F.coalesce("times", F.array().cast("array<bigint>")))
    return both.select("eid", "k", T.timestamp_line(F.col("times"), distinct=True).alias("line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(1 / (1 + exp(-value)), 6) AS chance, round(ln(p / (1 - p)), 6) AS logit, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-value)))) AS p FROM events)")
def scalar_chances(spark, d):
    p = T.sigmoid(F.col("value"))
    out = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), p.alias("chance"), T.logit(p).alias("logit"), T.entropy(p, 1e-6).alias("entropy"))
    return _rounded(out, "chance", "logit", "entropy")


@query("SELECT user_id, max(ts) AS ts, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY user_id")
def node_memory(spark, d):
    """The last message of each node; the same function keeps it as state over a stream."""
    return last_messages(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id"), "ts", "event_id", "value"))


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS age FROM d)
SELECT user_id, round(coalesce(sum(0.3 * pow(0.7, age - 1) * value) FILTER (age >= 1), 0), 6) AS memory, max(ts) FILTER (age = 1) AS updated, max(value) FILTER (age = 0) AS message, max(ts) FILTER (age = 0) AS at FROM n GROUP BY user_id""")
def memory_bank(spark, d):
    """Memories of the nodes after all days, each day a batch; the same function keeps them as state over a stream."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "value", F.date_trunc("day", "ts").alias("batch"))
    return _rounded(bank(rows, 0.3), "memory")


@query(f"""WITH {_EDGES} SELECT src AS node, q.eid * 4 + k AS ask, epoch_ms(t * 86400000) AS t, nbr, count(adj.ts) AS n FROM q LEFT JOIN adj ON node = src AND adj.ts < t AND adj.ts >= t - 120 GROUP BY ALL""")
def rolling_neighbors(spark, d):
    """The source's neighbours of the 120 days before each query; the same function answers a stream that arrives out of order."""
    events, q = _graph(spark, d)
    time = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    rows = D.adjacency(events).select("node", time("ts").alias("ts"), "nbr", F.lit(None).cast("long").alias("ask"))
    rows = rows.unionByName(q.select(F.col("src").alias("node"), time("t").alias("ts"), F.lit(None).cast("long").alias("nbr"), (F.col("eid") * 4 + F.col("k")).alias("ask")))
    return near(written(rows, "rolling"), 120 * 86400)


@query(f"WITH {_EDGES}, x AS (SELECT DISTINCT ts, ln(1 + (SELECT max(ts) FROM edges) - ts) AS x FROM edges) SELECT ts, 'fourier' AS kind, CAST(j AS INTEGER) AS dim, round(CASE WHEN j < 4 THEN sin(x * exp(ln(10000) * (j % 4) / 3.0)) ELSE cos(x * exp(ln(10000) * (j % 4) / 3.0)) END, 6) + 0.0 AS v FROM x, (SELECT unnest(range(8)) AS j) UNION ALL SELECT ts, 'rbf', CAST(j AS INTEGER), round(exp(-16 * pow(x / (1 + x) - j / 7.0, 2)), 6) FROM x, (SELECT unnest(range(8)) AS j)")
def time_bases(spark, d):
    """Fourier and radial bases of the time since each day."""
    events = D.edges(spark, d)
    last = events.agg(F.max("ts")).first()[0]
    days = events.select("ts").distinct()
    parts = [days.select("ts", F.lit(kind).alias("kind"), F.posexplode(f(F.lit(last) - F.col("ts"), 8)).alias("dim", "v")) for kind, f in (("fourier", T.fourier_time), ("rbf", T.rbf_time))]
    return _rounded(parts[0].union(parts[1]), "v")


_MARKS = "[" + ", ".join(f"'{m}'" for m in T.LOW_SIGNAL) + "]"


@query(rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT doc_id, t, list_min([strpos(lower(t), m) - 1 FOR m IN {_MARKS} IF strpos(lower(t), m) > 0]) AS place FROM c),
b AS (SELECT doc_id, CASE WHEN place >= 80 THEN regexp_replace(t[1:place], '[ ,;:-]+$', '') ELSE t END AS t FROM a), p AS (SELECT doc_id, t, [regexp_replace(x, '^[ .]+|[ .]+$', '', 'g') FOR x IN string_split(regexp_replace(t, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))] AS l FROM b),
g AS (SELECT doc_id, t, [x FOR x IN l IF x <> '' AND len([m FOR m IN {_MARKS} IF contains(lower(x), m)]) = 0 AND length(x) - length(replace(x, '|', '')) < 2 AND NOT regexp_matches(x, '^[0-9]+\.\s+\S') AND NOT regexp_matches(x, '(?i)^(disc|episode|chapter|side)\s+[0-9]+\b') AND NOT regexp_matches(x, '(?i)^(track|song|bonus)\s*[:-]')][1:2] AS good FROM p),
j AS (SELECT doc_id, t, good, array_to_string(good, '. ') AS s FROM g), w AS (SELECT doc_id, t, good, CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS s FROM j), k AS (SELECT *, regexp_replace(s[1:280], '[ ,;:-]+$', '') AS cut FROM w), z AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS sp FROM k)
SELECT doc_id, CASE WHEN t = '' THEN '' WHEN len(good) = 0 THEN CASE WHEN len(string_split(t, ' ')) <= 40 THEN t ELSE regexp_replace(array_to_string(string_split(t, ' ')[1:40], ' '), '[ ,;:-]+$', '') || '...' END
WHEN length(s) <= 280 THEN s ELSE regexp_replace(CASE WHEN strpos(cut, ' ') > 0 AND sp >= 80 THEN cut[1:sp] ELSE cut END, '[ ,;:-]+$', '') || '...' END AS summary FROM z""")
def text_summaries(spark, d):
    """The first two sentences of each whole text that say something, in at most 280 characters."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.summarise(T.normalise_space(F.col("text"))).alias("summary"))
