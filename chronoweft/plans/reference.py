"""Registered queries of the temporal-interaction operators, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.operators import ranking as R
from chronoweft.operators import registry
from chronoweft.operators import scorers as S
from chronoweft.operators import semantic as V
from chronoweft.operators import splits as P
from chronoweft.operators.prefix import batches
from chronoweft.sources import tables as D
from chronoweft.sources.written import written
from chronoweft.streaming.history import windowed_activity

def draw_sql(of: str, slot: str, size: str) -> str:
    """The rule of ``tables.draw``."""
    a = f"(({of}) % 2147483647 * 48271 + CAST({slot} AS BIGINT) * 69621 + 12345) % 2147483647"
    return f"((({a}) * ({a}) + ({a}) * 40692) % 2147483647 % ({size}))"


_EDGES = f"""edges AS (
  SELECT o_custkey AS u, l_partkey AS i, CAST(l_linenumber AS BIGINT) AS r,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ts, CAST(l_returnflag = 'R' AS INTEGER) AS label,
    l_orderkey * 65536 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS eid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
adj AS (SELECT u AS node, i AS nbr, ts, eid AS aeid, r, 'out' AS role FROM edges UNION ALL SELECT i, u, ts, eid, r, 'in' FROM edges),
cuts AS (SELECT quantile_cont(ts, 0.7) AS val_time, quantile_cont(ts, 0.85) AS test_time FROM edges),
pool AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT i AS node FROM edges)),
late AS (SELECT eid, u AS src, i, ts AS t FROM edges, cuts WHERE ts > test_time),
q AS (SELECT eid, CAST(0 AS INTEGER) AS k, src, i AS tgt, t FROM late
  UNION ALL SELECT eid, CAST(k AS INTEGER), src, node, t FROM (SELECT eid, k, src, t, {draw_sql("eid", "k", "SELECT count(*) FROM pool")} AS idx FROM late, (SELECT unnest([1, 2, 3]) AS k)) JOIN pool USING (idx))"""
_SPLIT = """split AS (SELECT edges.*, CASE WHEN ts <= val_time THEN 'train' WHEN ts <= test_time THEN 'val' ELSE 'test' END AS split FROM edges, cuts)"""
_BATCH = """bat AS (SELECT eid, CAST(floor((row_number() OVER (ORDER BY t, eid) - 1) / 64) AS BIGINT) AS batch FROM late)"""
_CN = """fc AS (SELECT node, nbr, min(ts) AS first_ts FROM adj GROUP BY ALL),
pairs AS (SELECT DISTINCT src, tgt, t FROM q),
common AS (SELECT p.*, a.nbr FROM pairs p JOIN fc a ON a.node = p.src AND a.first_ts < p.t JOIN fc b ON b.node = p.tgt AND b.nbr = a.nbr AND b.first_ts < p.t),
deg AS (SELECT c.nbr, c.t, count(*) AS d FROM (SELECT DISTINCT nbr, t FROM common) c JOIN adj ON adj.node = c.nbr AND adj.ts < c.t GROUP BY ALL),
cn AS (SELECT src, tgt, t, count(*) AS cn, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa, sum(1.0 / d) AS ra FROM common JOIN deg USING (nbr, t) GROUP BY ALL),
scored AS (SELECT eid, k, coalesce(cn, 0) AS cn, coalesce(aa, 0) AS aa, coalesce(ra, 0) AS ra FROM q LEFT JOIN cn USING (src, tgt, t))"""
_POP = """pop AS (SELECT eid, k, count(ts) AS popularity FROM q LEFT JOIN adj ON node = tgt AND ts < t GROUP BY ALL)"""
_PAST = """past AS (SELECT eid, k, count(ts) AS past, coalesce(CAST(max(ts) - any_value(t) AS DOUBLE), -1e15) AS recency FROM q LEFT JOIN adj ON node = src AND nbr = tgt AND ts < t GROUP BY ALL)"""
_FUSED = f"""{_CN}, {_POP}, {_PAST},
fused AS (SELECT eid, k, t, src, tgt, CASE WHEN k = 0 THEN 1 ELSE 0 END AS label, popularity, past, recency, ra,
  1.0 / (60 + row_number() OVER (PARTITION BY eid ORDER BY recency DESC, k)) + 1.0 / (60 + row_number() OVER (PARTITION BY eid ORDER BY popularity DESC, k))
  + 1.0 / (60 + row_number() OVER (PARTITION BY eid ORDER BY past DESC, k)) + 1.0 / (60 + row_number() OVER (PARTITION BY eid ORDER BY round(ra, 9) DESC, k)) AS rrf
  FROM scored JOIN pop USING (eid, k) JOIN past USING (eid, k) JOIN q USING (eid, k))"""
_RANKED = """byscore AS (SELECT popularity AS s, sum(label) AS p, sum(1 - label) AS n FROM fused GROUP BY 1),
cum AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM byscore)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events, written once, and the queries: every event of the test split, with three drawn targets each."""
    events = written(D.edges(spark, d), "events")
    _, test_time = P.boundaries(events)
    return events, D.queries(events, events.where(F.col("ts") > test_time))


def _in_batches(rows: DataFrame, size: int = 64) -> DataFrame:
    """``rows`` (eid, t) with ``batch``: consecutive groups of so many queries."""
    return rows.join(batches(rows.where("k = 0").select("eid", "t"), [F.col("t"), F.col("eid")], size).select("eid", "batch"), "eid")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.when(F.round(c, digits) == 0, 0.0).otherwise(F.round(c, digits)) for c in columns})


def fused(spark: SparkSession, d: str) -> DataFrame:
    """Four scorers of every query, fused by reciprocal ranks within it; written, as metrics read it several times."""
    events, q = _graph(spark, d)
    q = written(q, "queries")
    scores = S.pair_history(events, q).join(S.target_history(events, q).select("eid", "k", "popularity"), S.KEY).join(S.common_neighbors(events, q).select("eid", "k", F.round("ra", 9).alias("ra")), S.KEY)
    scores = scores.join(q.select("eid", "k", "t", "src", "tgt"), S.KEY)
    return written(R.reciprocal_rank_fusion(scores, ["recency", "popularity", "past", "ra"]).withColumn("label", (F.col("k") == 0).cast("int")), "fused")


def scored(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The named scores of every query, and no others; written, as metrics read them several times."""
    events, q = _graph(spark, d)
    rows = registry.scores(events, written(q, "queries"), columns)
    return written(rows.withColumns({"label": (F.col("k") == 0).cast("int")} | ({"ra": F.round("ra", 9)} if "ra" in columns else {})), "scored")


@query(f"WITH {_EDGES}, {_SPLIT} SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM split GROUP BY split")
def chronological_split(spark, d):
    return P.chronological(written(D.edges(spark, d), "events")).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {_EDGES}, {_SPLIT}, later AS (SELECT u AS node FROM split WHERE split <> 'train' UNION SELECT i FROM split WHERE split <> 'train'),
everyone AS (SELECT u AS node FROM edges UNION SELECT i FROM edges),
reserved AS (SELECT node FROM later QUALIFY row_number() OVER (ORDER BY node * 7919 % 10007, node) <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM everyone)),
obs AS (SELECT *, split = 'train' AND u NOT IN (FROM reserved) AND i NOT IN (FROM reserved) AS observed FROM split),
known AS (SELECT u AS node FROM obs WHERE observed UNION SELECT i FROM obs WHERE observed)
SELECT split, observed, u NOT IN (FROM known) OR i NOT IN (FROM known) AS is_new, count(*) AS n FROM obs GROUP BY ALL""")
def inductive_split(spark, d):
    split = written(P.chronological(written(D.edges(spark, d), "events")), "split")
    return P.inductive(split, written(P.reserve_nodes(split), "reserved")).groupBy("split", "observed", "is_new").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES}, ends AS (SELECT eid, ts, u AS node FROM edges UNION ALL SELECT eid, ts, i FROM edges), f AS (SELECT node, min(ts) AS m FROM ends GROUP BY 1) SELECT eid, CAST(max(CAST(ts = m AS INTEGER)) AS INTEGER) AS first_touch FROM ends JOIN f USING (node) GROUP BY eid")
def first_touch(spark, d):
    return P.first_touch(D.edges(spark, d))


@query(f"WITH {_EDGES} SELECT u, i, ts, count(*) AS multiplicity, min(eid) AS eid FROM edges GROUP BY u, i, ts")
def pair_pool(spark, d):
    return P.pair_pool(D.edges(spark, d))


@query(f"WITH {_EDGES} SELECT eid, k, src, tgt, t FROM q")
def query_table(spark, d):
    return _graph(spark, d)[1]


def _historical_sql(extra: str) -> str:
    return f"WITH {_EDGES}, p AS (SELECT u, i, min(ts) AS first_ts, max(ts) AS last_ts FROM edges GROUP BY u, i) SELECT * FROM p WHERE first_ts < 11000 {extra} AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = p.u AND e.i = p.i AND e.ts BETWEEN 11000 AND 11030)"


@query(_historical_sql(""))
def historical_negatives(spark, d):
    return P.historical_candidates(D.edges(spark, d), 11000, 11030)


@query(_historical_sql("AND first_ts > 10000"))
def inductive_negatives(spark, d):
    return P.historical_candidates(D.edges(spark, d), 11000, 11030, 10000)


@query(f"WITH {_EDGES}, {_PAST} SELECT eid, k, recency, past FROM past")
def score_pair_history(spark, d):
    return S.pair_history(*_graph(spark, d))


@query(f"WITH {_EDGES} SELECT eid, k, count(ts) AS popularity, coalesce(CAST(max(ts) - any_value(t) AS DOUBLE), -1e15) AS global_recency FROM q LEFT JOIN adj ON node = tgt AND ts < t GROUP BY ALL")
def score_target_history(spark, d):
    return S.target_history(*_graph(spark, d))


@query(f"WITH {_EDGES} SELECT eid, k, round(coalesce(sum(exp(-0.001 * (t - ts))), 0), 6) AS decayed_popularity FROM q LEFT JOIN adj ON node = tgt AND ts < t GROUP BY ALL")
def score_decayed_popularity(spark, d):
    return _rounded(S.decayed_popularity(*_graph(spark, d), 0.001, 9131), "decayed_popularity")


@query(f"WITH {_EDGES} SELECT eid, k, count(ts) AS recent_degree FROM q LEFT JOIN adj ON node = tgt AND ts < t AND ts >= t - 90 GROUP BY ALL")
def score_recent_degree(spark, d):
    return S.recent_degree(*_graph(spark, d), 90)


@query(f"WITH {_EDGES}, {_CN} SELECT eid, k, cn, round(aa, 6) AS aa, round(ra, 6) AS ra FROM scored")
def score_common_neighbors(spark, d):
    return _rounded(S.common_neighbors(*_graph(spark, d)), "aa", "ra")


@query(f"""WITH {_EDGES}, h AS (SELECT edges.* FROM edges, cuts WHERE ts <= test_time), gaps AS (SELECT u, i, ts - lag(ts) OVER (PARTITION BY u, i ORDER BY ts, eid) AS gap FROM h),
mean_gap AS (SELECT u, i, avg(gap) AS gap FROM gaps GROUP BY u, i), w AS (SELECT sum(coalesce(gap, 0)) / count(*) AS interval FROM mean_gap),
b AS (SELECT max(ts) AS last, quantile_cont(ts, 0.85) AS recent_from FROM h),
mem AS (SELECT u, i, count(*) AS n, max(ts) AS last_ts FROM h GROUP BY u, i)
SELECT eid, k, CAST(mem.n IS NOT NULL AS INTEGER) AS unlimited, CAST(coalesce(last_ts >= recent_from, FALSE) AS INTEGER) AS recent,
  CAST(coalesce(last_ts >= last - interval, FALSE) AS INTEGER) AS repeated, CAST(coalesce(mem.n >= (SELECT avg(n) FROM mem), FALSE) AS INTEGER) AS frequent
FROM q LEFT JOIN mem ON mem.u = src AND mem.i = tgt, b, w""")
def score_edge_memory(spark, d):
    events, q = _graph(spark, d)
    return S.edge_memory(events, q, P.boundaries(events)[1])


@query(f"WITH {_EDGES}, g AS (SELECT u, i, ts - lag(ts) OVER (PARTITION BY u, i ORDER BY ts, eid) AS gap FROM edges), m AS (SELECT avg(gap) AS gap FROM g GROUP BY u, i) SELECT round(sum(coalesce(gap, 0)) / count(*), 6) AS repeat_interval FROM m")
def memory_repeat_interval(spark, d):
    return _rounded(S.repeat_interval(D.edges(spark, d)), "repeat_interval")


@query(f"""WITH {_EDGES}, b AS (SELECT DISTINCT u, i, ts, dense_rank() OVER (PARTITION BY u ORDER BY ts) AS n FROM edges),
tr AS (SELECT x.i AS a, y.i AS b, y.ts FROM b x JOIN b y ON x.u = y.u AND y.n = x.n + 1),
lastb AS (SELECT eid, k, src, any_value(tgt) AS tgt, any_value(t) AS t, max(ts) AS last_ts FROM q JOIN (SELECT u, ts FROM edges) e ON e.u = src AND ts < t GROUP BY eid, k, src),
items AS (SELECT DISTINCT eid, k, tgt, t, i AS a FROM lastb JOIN (SELECT u, i, ts FROM edges) e ON e.u = src AND ts = last_ts),
totals AS (SELECT x.a, x.t, count(*) AS al FROM (SELECT DISTINCT a, t FROM items) x JOIN tr ON tr.a = x.a AND tr.ts < x.t GROUP BY ALL),
hits AS (SELECT x.a, x.tgt, x.t, count(*) AS n FROM (SELECT DISTINCT a, tgt, t FROM items) x JOIN tr ON tr.a = x.a AND tr.b = x.tgt AND tr.ts < x.t GROUP BY ALL),
s AS (SELECT eid, k, avg(CASE WHEN al > 0 THEN coalesce(n, 0) / al ELSE 0 END) AS markov FROM items LEFT JOIN totals USING (a, t) LEFT JOIN hits USING (a, tgt, t) GROUP BY eid, k)
SELECT eid, k, round(coalesce(markov, 0), 6) AS markov FROM q LEFT JOIN s USING (eid, k)""")
def score_markov(spark, d):
    events, q = _graph(spark, d)
    return _rounded(S.markov(events, written(q, "queries")), "markov")


@query(f"""WITH {_EDGES}, r AS (SELECT eid, k, nbr, ts, row_number() OVER (PARTITION BY eid, k ORDER BY ts DESC, aeid DESC, nbr DESC) - 1 AS age
FROM q JOIN adj ON node = src AND ts < t) SELECT eid, k, age, nbr, ts FROM r WHERE age < 10""")
def recent_neighbors(spark, d):
    return S.recent_neighbors(*_graph(spark, d), 10)


@query(f"""WITH {_EDGES}, g AS (SELECT 'u' AS role, ts - coalesce(lag(ts) OVER (PARTITION BY u ORDER BY ts, eid), 0) AS gap FROM edges
UNION ALL SELECT 'i', ts - coalesce(lag(ts) OVER (PARTITION BY i ORDER BY ts, eid), 0) FROM edges) SELECT role, round(avg(gap), 6) AS mean_shift, round(stddev_pop(gap), 6) AS std_shift FROM g GROUP BY role""")
def time_shifts(spark, d):
    return _rounded(S.time_shifts(D.edges(spark, d)), "mean_shift", "std_shift")


@query(f"WITH {_EDGES}, {_FUSED} SELECT eid, k, round(rrf, 9) AS rrf FROM fused")
def rank_fusion(spark, d):
    return _rounded(fused(spark, d).select("eid", "k", "rrf"), "rrf", digits=9)


@query(f"""WITH {_EDGES}, {_FUSED}, r AS (SELECT a.eid, sum(CAST(round(b.rrf, 9) >= round(a.rrf, 9) AS INTEGER)) AS ge, sum(CAST(round(b.rrf, 9) > round(a.rrf, 9) AS INTEGER)) AS gt FROM fused a JOIN fused b ON a.eid = b.eid AND a.k = 0 AND b.k > 0 GROUP BY a.eid)
SELECT round(avg(1 / (1 + ge)), 6) AS mrr, avg(CAST(gt < 1 AS DOUBLE)) AS hits_1, avg(CAST(gt < 3 AS DOUBLE)) AS hits_3, avg(CAST(gt < 10 AS DOUBLE)) AS hits_10 FROM r""")
def fusion_mrr_hits(spark, d):
    return _rounded(R.mrr_and_hits(_rounded(fused(spark, d), "rrf", digits=9), "rrf"), "mrr")


@query(f"WITH {_EDGES}, {_FUSED}, {_RANKED} SELECT round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS ap FROM cum")
def popularity_auc_ap(spark, d):
    return _rounded(R.auc_and_ap(scored(spark, d, "popularity"), "popularity"), "auc", "ap")


@query(f"""WITH {_EDGES}, {_FUSED}, {_RANKED}, t AS (SELECT s AS threshold, round((tp / sum(p) OVER () + 1 - fp / sum(n) OVER ()) / 2, 9) AS balanced_accuracy FROM cum)
SELECT threshold, balanced_accuracy FROM t ORDER BY balanced_accuracy DESC, threshold LIMIT 1""")
def balanced_threshold(spark, d):
    return R.balanced_threshold(scored(spark, d, "popularity"), "popularity")


@query(f"""WITH {_EDGES}, {_FUSED}, c AS (SELECT quantile_cont(popularity, 0.3) AS lo, quantile_cont(popularity, 0.7) AS hi FROM fused)
SELECT eid, k, CASE WHEN lo = hi THEN 'Modest' WHEN popularity >= hi THEN 'High' WHEN popularity <= lo THEN 'Low' ELSE 'Modest' END AS level FROM fused, c""")
def level_buckets(spark, d):
    return R.level_buckets(scored(spark, d, "popularity"), "popularity").select("eid", "k", "level")


@query(f"""WITH {_EDGES}, {_FUSED}, b AS (SELECT min(popularity) AS lo, max(popularity) AS hi FROM fused WHERE k <= 1)
SELECT eid, k, round(greatest(0, least(1, (popularity - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END))), 9) AS popularity FROM fused, b""")
def minmax_scaled(spark, d):
    rows = scored(spark, d, "popularity").select("eid", "k", "popularity")
    return _rounded(R.minmax(rows, R.fit_bounds(rows.where("k <= 1"), ["popularity"]), ["popularity"]), "popularity", digits=9)


@query(f"""WITH {_EDGES}, {_FUSED}, {_BATCH}, w AS (SELECT eid, k, popularity, batch, count(*) OVER (PARTITION BY batch) AS n, row_number() OVER (PARTITION BY batch ORDER BY popularity, eid, k) - 1 AS pos FROM fused JOIN bat USING (eid))
SELECT eid, k, popularity, batch FROM w WHERE pos >= greatest((n - 50) // 2, 0) AND pos < greatest((n - 50) // 2, 0) + 50""")
def middle_band(spark, d):
    rows = _in_batches(scored(spark, d, "popularity")).select("eid", "k", "popularity", "batch")
    return R.middle_band(rows, "popularity", "batch", 50, ["eid", "k"])


@query(f"""WITH {_EDGES}, {_FUSED}, {_RANKED} SELECT round(max(abs(tp / (SELECT sum(p) FROM cum) - fp / (SELECT sum(n) FROM cum))), 9) AS ks FROM cum""")
def ks_distance(spark, d):
    return _rounded(R.ks_distance(scored(spark, d, "popularity"), "popularity", "label"), "ks", digits=9)


@query(f"""WITH {_EDGES}, {_FUSED}, ref AS (SELECT popularity AS v FROM fused WHERE k = 0), n AS (SELECT count(*) AS n FROM ref),
x AS (SELECT popularity AS v, (SELECT count(*) FROM ref WHERE ref.v < f.popularity) AS lt, (SELECT count(*) FROM ref WHERE ref.v <= f.popularity) AS le, eid, k FROM fused f)
SELECT eid, k, round(CASE WHEN n <= 1 THEN 50 ELSE greatest(0, least(100, (lt + le - 1) / 2 / (n - 1) * 100)) END, 6) AS percentile FROM x, n""")
def score_percentile(spark, d):
    rows = scored(spark, d, "popularity").select("eid", "k", "popularity")
    return _rounded(R.percentile_of(rows, rows.where("k = 0"), "popularity").select("eid", "k", "percentile"), "percentile")


@query("""WITH x AS (SELECT l_linenumber AS y, CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 1 END AS g FROM lineitem),
c AS (SELECT y AS c FROM x UNION SELECT g FROM x),
m AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) AS s, (SELECT count(*) FROM x WHERE g = c) AS gv, (SELECT count(*) FROM x WHERE y = c AND g = c) AS tp FROM c),
k AS (SELECT s, tp, CASE WHEN gv > 0 THEN tp / gv ELSE 0 END AS p, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS r FROM m),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM k)
SELECT round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r, round(avg(f), 6) AS macro_f1, round(sum(tp) / sum(s), 6) AS micro_f1, round(sum(p * s) / sum(s), 6) AS weighted_p, round(sum(f * s) / sum(s), 6) AS weighted_f1 FROM f""")
def multiclass_metrics(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("y"), F.when(F.col("l_quantity") > 25, F.col("l_linenumber")).otherwise(1).alias("g"))
    out = R.confusion_metrics(rows, "y", "g")
    return _rounded(out, *out.columns)


_VECTORS = "vectors AS (SELECT vec_id AS node, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))


@query(f"WITH {_EDGES}, {_VECTORS} SELECT eid, k, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS similarity FROM q LEFT JOIN vectors a ON a.node = src LEFT JOIN vectors b ON b.node = tgt")
def semantic_similarity(spark, d):
    return _rounded(V.similarity(_graph(spark, d)[1], _vectors(spark, d)), "similarity")


@query(f"WITH {_EDGES}, {_VECTORS}, l AS (SELECT u, unnest(v) AS x, unnest(range(len(v))) AS dim FROM edges JOIN vectors ON node = i) SELECT u AS node, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS x FROM l GROUP BY ALL")
def semantic_history_mean(spark, d):
    return _rounded(V.history_mean(D.edges(spark, d), _vectors(spark, d)), "x")


@query(f"""WITH {_EDGES}, {_VECTORS}, l AS (SELECT u, unnest(b.v) AS x, unnest(range(len(b.v))) AS dim FROM edges JOIN cuts ON ts <= test_time JOIN vectors a ON a.node = u JOIN vectors b ON b.node = i), m AS (SELECT u, dim, avg(x) AS x FROM l GROUP BY ALL),
n AS (SELECT u, dim, x / sqrt(sum(x * x) OVER (PARTITION BY u)) AS x FROM m), o AS (SELECT node, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vectors)
SELECT o.node, CAST(o.dim AS INTEGER) AS dim, round(coalesce(n.x, o.x), 6) + 0.0 AS x FROM o LEFT JOIN n ON n.u = o.node AND n.dim = o.dim""")
def initialised_sources(spark, d):
    """Vectors whose sources start from the mean of their history up to the test split."""
    events = written(D.edges(spark, d), "events")
    out = V.initialised_sources(events.where(F.col("ts") <= P.boundaries(events)[1]), _vectors(spark, d))
    return _rounded(out.select("node", F.posexplode("v").alias("dim", "x")), "x")


@query(f"""WITH {_EDGES}, {_VECTORS}, a AS (SELECT u, i, sum(w) AS w FROM (SELECT node AS u, nbr AS i, 1.0::DOUBLE AS w FROM adj WHERE node IN (SELECT node FROM vectors) AND nbr IN (SELECT node FROM vectors) UNION ALL SELECT node, node, 1 FROM vectors) GROUP BY ALL),
deg AS (SELECT u, greatest(sum(w), 1) AS d FROM a GROUP BY u),
l AS (SELECT a.u, w / sqrt(x.d * y.d) AS w, unnest(v) AS x, unnest(range(len(v))) AS dim FROM a JOIN deg x ON x.u = a.u JOIN deg y ON y.u = a.i JOIN vectors ON node = a.i)
SELECT u AS node, CAST(dim AS INTEGER) AS dim, CASE WHEN round(sum(w * x), 6) = 0 THEN 0.0::DOUBLE ELSE round(sum(w * x), 6) END AS x FROM l GROUP BY ALL""")
def semantic_smoothing(spark, d):
    return _rounded(V.smooth(D.edges(spark, d), _vectors(spark, d)), "x")


_SPACES = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+"
_REFERENCES = {"&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": "\u00a0", "&amp;": "&"}


def _unescaped_sql(column: str) -> str:
    """The references that the pages hold; the SQL knows no others."""
    for name, char in _REFERENCES.items():
        column = f"replace({column}, '{name}', '{char}')"
    return column


@query(f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace({_unescaped_sql("html")}, '<![CDATA[', ' '), ']]>', ' '),
'(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_SPACES}', ' ', 'g')) AS text FROM pages""")
def text_strip_markup(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query(r"""WITH x AS (SELECT conv_id, turn, text, regexp_extract(text, '(?s)Therefore, the answer is:.*?([0-9]{1,3})', 1) AS a, regexp_extract(text, '(?i)answer is:\s*([0-9]{1,3})', 1) AS b,
regexp_extract_all(text, '\b([0-9]{1,3})\b', 1) AS c FROM conversations),
y AS (SELECT conv_id, turn, sha256(text) AS sha, CASE WHEN a <> '' THEN 'exact_phrase' WHEN b <> '' THEN 'answer_phrase_fallback' WHEN len(c) > 0 THEN 'last_integer_fallback' ELSE 'parse_failed' END AS method,
CAST(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN len(c) > 0 THEN c[-1] END AS INTEGER) AS v FROM x)
SELECT conv_id, turn, sha, method, CASE WHEN v > 100 THEN 100 ELSE v END AS score FROM y""")
def text_scores(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.sha256(F.col("text")).alias("sha"), T.parse_score(F.col("text")).alias("p"))
    return rows.select("conv_id", "turn", "sha", "p.method", "p.score")


@query("""WITH x AS (SELECT event_id, user_id, CAST(floor(value * 10 + 0.5) AS BIGINT) AS d, value FROM events)
SELECT event_id, CASE WHEN d < 0 THEN 'future' WHEN d = 0 THEN 'today' ELSE concat_ws(', ',
  CASE WHEN d // 365 > 0 THEN (d // 365) || ' year' || (CASE WHEN d // 365 > 1 THEN 's' ELSE '' END) END,
  CASE WHEN d % 365 // 30 > 0 THEN (d % 365 // 30) || ' month' || (CASE WHEN d % 365 // 30 > 1 THEN 's' ELSE '' END) END,
  CASE WHEN d % 365 % 30 > 0 THEN (d % 365 % 30) || ' day' || (CASE WHEN d % 365 % 30 > 1 THEN 's' ELSE '' END) END) END AS age,
  round(-ln(1 + value), 6) AS log_recency, round(sign(value) * sqrt(abs(value)), 6) AS signed_root FROM x""")
def scalar_transforms(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select("event_id", T.duration_text(F.floor(F.col("value") * 10 + 0.5)).alias("age"), F.round(T.log_recency(F.col("value")), 6).alias("log_recency"), F.round(T.signed_sqrt(F.col("value")), 6).alias("signed_root"))


@query("SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS n, round(sum(value), 6) AS total, max(ts) AS last_ts FROM events GROUP BY ALL")
def windowed_user_activity(spark, d):
    return _rounded(windowed_activity(spark.read.parquet(f"{d}/events.parquet")), "total")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: scorers, fusion and ranking metrics of every event of the test split."""
    return _rounded(R.mrr_and_hits(fused(spark, d), "rrf"), "mrr")
