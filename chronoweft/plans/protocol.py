"""Registered queries of the training protocol, of negative draws and samples, and of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import history as H
from chronoweft.operators import protocol as X
from chronoweft.operators import sampling as N
from chronoweft.operators import splits as P
from chronoweft.plans.reference import _EDGES, _SPLIT, _graph, _rounded, _vectors, draw_sql, query
from chronoweft.plans.sampling import _POOL
from chronoweft.sources import files as S
from chronoweft.sources import tables as D
from chronoweft.sources.written import new_path, written

_RESERVED = f"""{_SPLIT}, later AS (SELECT u AS node FROM split WHERE split <> 'train' UNION SELECT i FROM split WHERE split <> 'train'),
everyone AS (SELECT u AS node FROM edges UNION SELECT i FROM edges),
reserved AS (SELECT node FROM later QUALIFY row_number() OVER (ORDER BY node * 7919 % 10007, node) <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM everyone)),
obs AS (SELECT *, split = 'train' AND u NOT IN (FROM reserved) AND i NOT IN (FROM reserved) AS observed FROM split),
known AS (SELECT u AS node FROM obs WHERE observed UNION SELECT i FROM obs WHERE observed)"""


def _events(spark, d):
    return written(D.edges(spark, d), "events")


@query(f"WITH {_EDGES}, {_RESERVED} SELECT eid, split, observed, u NOT IN (FROM known) OR i NOT IN (FROM known) AS is_new FROM obs")
def training_protocol(spark, d):
    return X.training_protocol(_events(spark, d)).select("eid", "split", "observed", "is_new")


@query(f"WITH {_EDGES}, {_RESERVED} SELECT eid, u, i, ts, 'observed_train' AS scope FROM obs WHERE observed")
def protocol_history(spark, d):
    return X.require_scope(X.protocol_history(X.training_protocol(_events(spark, d)))).select("eid", "u", "i", "ts", "scope")


@query("SELECT unnest(['late_history', 'unobserved_history', 'unobserved_ends', 'foreign_negatives']) AS rule, CAST(0 AS BIGINT) AS n")
def protocol_violations(spark, d):
    """All observed training events with drawn negatives and their histories: every rule holds."""
    p = written(X.training_protocol(_events(spark, d)), "protocol")
    observed = X.protocol_history(p)
    q = written(D.queries(observed, negatives=1), "queries")
    history = written(H.endpoint_history(written(H.numbered_events(observed), "numbered"), q, "src", 10), "history")
    found = written(X.violations(p, q, history, q.where("k > 0")), "violations")
    X.require_clean(found)
    return found


@query(f"WITH {_EDGES}, {_SPLIT} SELECT eid, u, i, ts, CAST(label AS BIGINT) AS r, split FROM split")
def edge_classification(spark, d):
    return X.edge_classification(P.chronological(_events(spark, d))).select("eid", "u", "i", "ts", "r", "split")


@query(f"WITH {_EDGES} SELECT eid, u, i, ts FROM edges WHERE ts < 10000")
def graph_history(spark, d):
    return X.graph_history(D.edges(spark, d), 10000).select("eid", "u", "i", "ts")


@query(f"WITH {_EDGES} SELECT side, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT 'left' AS side, ts FROM edges, cuts WHERE ts >= val_time AND ts < test_time UNION ALL SELECT 'right', ts FROM edges, cuts WHERE ts > val_time AND ts <= test_time) GROUP BY side")
def eval_edges(spark, d):
    events = _events(spark, d)
    low, high = P.boundaries(events)
    parts = [X.eval_edges(events, low, high, c).select(F.lit(c).alias("side"), "ts") for c in ("left", "right")]
    return parts[0].union(parts[1]).groupBy("side").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {_EDGES}, x AS (SELECT *, row_number() OVER (ORDER BY ts DESC, eid DESC) - 1 AS place, count(*) OVER () AS n FROM edges WHERE ts >= 10500) SELECT eid, ts FROM x WHERE place < floor(0.5 * n)""")
def recency_cutoff(spark, d):
    return P.recency_cutoff(_events(spark, d), 10500, 0.5).select("eid", "ts")


@query(f"""WITH {_EDGES}, s AS (SELECT label - (CASE WHEN min(label) OVER () <> 0 THEN 1 ELSE 0 END) AS label, ts // 15 AS bucket FROM (SELECT label + 1 AS label, ts FROM edges)) SELECT bucket, CAST(label AS INTEGER) AS label, count(*) AS n FROM s GROUP BY ALL""")
def label_and_time_buckets(spark, d):
    """Labels that start at 1 are rebased; times fall into buckets of 15."""
    shifted = D.edges(spark, d).withColumn("label", F.col("label") + 1)
    return D.bucket_time(D.rebase_labels(shifted)).groupBy(F.col("ts").alias("bucket"), "label").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES} SELECT u, r, i, CAST(ts AS DOUBLE) AS ts, label, count(*) AS n FROM edges GROUP BY ALL")
def edge_csv_scan(spark, d):
    """The events, written as an edge list with a header and read again."""
    path = new_path(spark, "edge-csv")
    D.edges(spark, d).select("label", "ts", "i", "r", "u").write.option("header", True).csv(path)
    return D.validate(D.read_edges_csv(spark, path), D.EDGE_SCHEMA).groupBy("u", "r", "i", "ts", "label").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS i, coalesce(p_name, '') AS text FROM part")
def entity_text_scan(spark, d):
    path = new_path(spark, "entity-text")
    spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("text")).write.option("header", True).option("escape", '"').csv(path)
    return D.read_texts(spark, path)


@query("""WITH v AS (SELECT vec_id, count(*) AS n, any_value(embedding) AS v FROM embeddings GROUP BY vec_id) SELECT CAST(sum(n) AS BIGINT) AS vectors, CAST(sum(n) - count(*) AS BIGINT) AS repeated, CAST(max(vec_id) - min(vec_id) + 1 - count(*) AS BIGINT) AS gaps,
count(*) FILTER (len(v) <> 64) AS wrong_length, count(*) FILTER (list_max([abs(x) FOR x IN v]) = 0) AS zero, count(*) FILTER (NOT list_bool_and([isfinite(x) FOR x IN v])) AS not_finite FROM v""")
def vector_problems(spark, d):
    return D.vector_problems(_vectors(spark, d), 64)


@query("SELECT conv_id AS query_id, turn, text AS prompt, CAST(role = 'assistant' AS INTEGER) AS label, sha256(text) AS prompt_sha256 FROM conversations WHERE text IS NOT NULL")
def prompt_jsonl(spark, d):
    """Prompts, written as JSON lines with their digests, read again and verified."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null").select(F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("prompt"), (F.col("role") == "assistant").cast("int").alias("label"))
    path = new_path(spark, "prompts")
    S.write_prompts(rows, path)
    return S.read_prompts(spark, path, "query_id long, turn long, label int")


@query(None)
def edge_fingerprint(spark, d):
    events = D.edges(spark, d)
    return spark.createDataFrame([(X.fingerprint(events, ["u", "r", "i", "ts", "label"], ["ts", "eid"]),)], "sha256 string")


_PAIRS = "taken AS (SELECT DISTINCT u AS src, i AS tgt FROM edges)"


def _free_sql(name: str, asked: str, taken: str, keys: str) -> str:
    """Rows of ``asked`` (keys, eid, k) with a drawn target that ``taken`` (keys, tgt) leaves free."""
    same = " AND ".join(f"h.{k} = s.{k}" for k in keys.split(", "))
    return f"""{name}_h AS (SELECT {keys}, idx, row_number() OVER (PARTITION BY {keys} ORDER BY idx) - 1 AS j FROM (SELECT DISTINCT * FROM {taken}) JOIN pool ON node = tgt),
{name}_n AS (SELECT {keys}, count(*) AS held FROM {name}_h GROUP BY ALL), {name}_s AS (SELECT *, {draw_sql("eid", "k", "(SELECT count(*) FROM pool) - coalesce(held, 0)")} AS place FROM {asked} LEFT JOIN {name}_n USING ({keys})),
{name}_m AS (SELECT s.eid, s.k, any_value(place) + count(h.idx) AS idx FROM {name}_s s LEFT JOIN {name}_h h ON {same} AND h.idx - h.j <= place GROUP BY ALL), {name} AS (SELECT eid, k, node AS tgt FROM {name}_m JOIN pool USING (idx))"""


@query(f"""WITH {_EDGES}, {_PAIRS}, slots AS (SELECT eid, CAST(k AS INTEGER) AS k, src, t FROM late, (SELECT unnest([1, 2]) AS k)), {_free_sql("free", "slots", "taken", "src")}
SELECT eid, k, src, tgt, t FROM slots JOIN free USING (eid, k)""")
def checked_negatives(spark, d):
    events, q = _graph(spark, d)
    return N.checked_negatives(events, q.where("k = 0"), 2, events)


def _drawn_historical(low: str, gap: int) -> str:
    """Negatives of each batch of 64 test events: four draws a place first, then all that the batch may draw, then free targets."""
    may = f"NOT EXISTS (SELECT 1 FROM edges x WHERE x.u = c.u AND x.i = c.i AND x.ts BETWEEN c.s AND c.e) AND c.s - (SELECT max(ts) FROM edges x WHERE x.u = c.u AND x.i = c.i AND x.ts < c.s) >= {gap}"
    return f"""WITH {_EDGES}, b AS (SELECT eid, src, t, CAST(floor(n / 64) AS BIGINT) AS batch, n % 64 AS place FROM (SELECT *, row_number() OVER (ORDER BY t, eid) - 1 AS n FROM late)),
pr AS (SELECT *, row_number() OVER (ORDER BY f, u, i) - 1 AS idx FROM (SELECT u, i, min(ts) AS f FROM edges GROUP BY u, i)),
sp AS (SELECT batch, min(t) AS s, max(t) AS e, count(*) AS need, {low} AS lo, (SELECT count(*) FROM pr WHERE f < min(b.t)) AS hi FROM b GROUP BY batch),
d AS (SELECT batch, s, e, lo + {draw_sql("batch", "j", "hi - lo")} AS idx, j FROM (SELECT *, unnest(range(4 * need)) AS j FROM sp WHERE hi > lo)),
c1 AS (SELECT batch, s, e, u, i, idx, min(j) AS j FROM d JOIN pr USING (idx) GROUP BY ALL),
g1 AS (SELECT batch, idx, u, i, place FROM (SELECT c.*, row_number() OVER (PARTITION BY batch ORDER BY j) - 1 AS place FROM c1 c WHERE {may}) JOIN sp USING (batch) WHERE place < need),
sh AS (SELECT sp.*, coalesce(h.n, 0) AS have FROM sp LEFT JOIN (SELECT batch, count(*) AS n FROM g1 GROUP BY batch) h USING (batch) WHERE coalesce(h.n, 0) < need),
c2 AS (SELECT batch, s, e, idx, u, i FROM (SELECT *, unnest(range(lo, hi)) AS idx FROM sh WHERE hi > lo) JOIN pr USING (idx) ANTI JOIN g1 USING (batch, idx)),
g2 AS (SELECT batch, idx, u, i, have + n AS place FROM (SELECT c.*, row_number() OVER (PARTITION BY batch ORDER BY {draw_sql("idx", "batch", "2147483647")}, idx) - 1 AS n FROM c2 c WHERE {may}) JOIN sh USING (batch) WHERE have + n < need),
g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2), bare AS (SELECT b.eid, 1 AS k, b.src, b.batch, sp.s, sp.e FROM b JOIN sp USING (batch) ANTI JOIN g USING (batch, place)),
near AS (SELECT src, s, e, i AS tgt FROM (SELECT DISTINCT src, s, e FROM bare) JOIN edges ON u = src AND ts BETWEEN s AND e), {_free_sql("free", "bare", "near", "src, s, e")}
SELECT b.eid, coalesce(g.u, b.src) AS src, coalesce(g.i, free.tgt) AS tgt, t, b.batch, CASE WHEN g.u IS NULL THEN 'random' ELSE 'historical' END AS kind FROM b LEFT JOIN g USING (batch, place) LEFT JOIN free ON free.eid = b.eid"""


def _historical(spark, d, late: bool, **options):
    events, q = _graph(spark, d)
    since = {"observed_until": P.boundaries(events)[1]} if late else {}
    return N.batch_negatives(events, q.where("k = 0"), **since, **options)


@query(_drawn_historical("0", 30))
def historical_negative_draws(spark, d):
    """Negatives drawn anew for each batch from the pairs of the past, last seen at least 30 days before."""
    return _historical(spark, d, False, least_gap=30)


@query(_drawn_historical("(SELECT count(*) FROM pr, cuts WHERE f <= test_time)", 0))
def inductive_negative_draws(spark, d):
    """Pairs first seen in the test split only: the first batches find few or none, and random targets fill up."""
    return _historical(spark, d, True)



@query(f"WITH {_EDGES}, n AS (SELECT eid, row_number() OVER (ORDER BY t, eid) - 1 AS n FROM late) SELECT eid, CAST(n // 256 AS BIGINT) AS \"group\", n % 256 AS place FROM n")
def canonical_groups(spark, d):
    _, q = _graph(spark, d)
    return N.canonical_groups(q.where("k = 0")).select("eid", "group", "place")


@query(f"""WITH {_EDGES}, {_POOL}, n AS (SELECT eid, row_number() OVER (ORDER BY t, eid) - 1 AS n FROM late) SELECT CAST(n // 256 AS BIGINT) AS "group", n % 256 AS place, k, tgt FROM anyway JOIN n USING (eid)""")
def frozen_negatives(spark, d):
    """Negatives frozen by group and place, written as a table and replayed."""
    events, q = _graph(spark, d)
    groups = N.canonical_groups(q.where("k = 0")).select("eid", "group", "place")
    frozen = written(N.random_negatives(events, q.where("k = 0"), 4).join(groups, "eid").select("group", "place", "k", "tgt"), "negatives")
    return groups.join(frozen, ["group", "place"]).select("group", "place", "k", "tgt")


def _hash_order(c: str) -> str:
    return draw_sql(c, "0", "2147483647")


@query(f"""WITH {_EDGES}, n AS (SELECT *, (row_number() OVER (ORDER BY ts, eid) - 1) // 32 AS block FROM edges), bl AS (SELECT block FROM (SELECT DISTINCT CAST(block AS BIGINT) AS block FROM n) ORDER BY {_hash_order("block")}, block LIMIT 15)
SELECT 'random' AS mode, eid FROM (SELECT eid FROM edges ORDER BY {_hash_order("eid")}, eid LIMIT 500) UNION ALL SELECT 'most_recent', eid FROM (SELECT eid FROM edges ORDER BY ts DESC, eid DESC LIMIT 500) UNION ALL SELECT 'blocks', eid FROM n SEMI JOIN bl USING (block)""")
def positive_samples(spark, d):
    events, out = _events(spark, d), None
    for mode in ("random", "most_recent", "blocks"):
        part = N.positive_sample(events, 500, mode).select(F.lit(mode).alias("mode"), "eid")
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {_EDGES}, ends AS (SELECT eid, ts, u AS node FROM edges UNION ALL SELECT eid, ts, i FROM edges), f AS (SELECT node, min(ts) AS m FROM ends GROUP BY 1),
ft AS (SELECT eid, CAST(max(CAST(ts = m AS INTEGER)) AS INTEGER) AS first_touch FROM ends JOIN f USING (node) GROUP BY eid), n AS (SELECT e.eid, ts, first_touch, row_number() OVER (ORDER BY ts DESC, e.eid DESC) - 1 AS n FROM edges e JOIN ft USING (eid)),
r AS (SELECT * FROM n WHERE n >= 200), a AS (SELECT * FROM r WHERE first_touch = 1 ORDER BY n LIMIT 60)
SELECT eid, ts, first_touch FROM (SELECT *, 0 AS turn FROM a UNION ALL SELECT *, 1 + first_touch FROM r WHERE eid NOT IN (SELECT eid FROM a)) ORDER BY turn, n LIMIT 300""")
def training_positives(spark, d):
    events = _events(spark, d)
    return N.training_positives(events.join(P.first_touch(events), "eid"), 300, 0.2, skip_latest=200).select("eid", "ts", "first_touch")


@query(f"WITH {_EDGES}, s AS (SELECT eid FROM late ORDER BY {_hash_order('eid')}, eid LIMIT 100) SELECT eid, k, src, tgt, t FROM q SEMI JOIN s USING (eid)")
def query_subset(spark, d):
    _, q = _graph(spark, d)
    return N.query_subset(written(q, "queries"), 100)


@query(f"WITH {_EDGES}, s AS (SELECT eid FROM late ORDER BY t DESC, eid DESC LIMIT 100) SELECT eid, k, src, tgt, t FROM q SEMI JOIN s USING (eid) WHERE k <= 1")
def recent_pairs(spark, d):
    _, q = _graph(spark, d)
    return N.recent_pairs(written(q, "queries"), 100)


@query("SELECT CAST(0 AS BIGINT) AS different")
def recent_tail_check(spark, d):
    events = _events(spark, d)
    return N.same_tail(N.positive_sample(events, 500, "most_recent"), events, 500)


@query(None)
def training_pools(spark, d):
    events, q = _graph(spark, d)
    return N.training_pools(q.where("k = 0"), events.select(F.col("i").alias("node")), 3, 16)


_WEIGHED = """wx AS (SELECT node, nbr, ts, row_number() OVER o AS seq, exp(0.2 * (ts - max(ts) OVER (PARTITION BY node))) AS x FROM adj WINDOW o AS (PARTITION BY node ORDER BY ts, aeid, nbr, role DESC)),
wr AS (SELECT *, sum(x) OVER (PARTITION BY node ORDER BY seq) AS run FROM wx), ww AS (SELECT *, CASE WHEN run > 0 THEN exp(x / run) ELSE 0 END AS weight FROM wr), wu AS (SELECT *, sum(weight) OVER (PARTITION BY node ORDER BY seq) AS upto FROM ww)"""


@query(f"""WITH {_EDGES}, {_WEIGHED}, r AS (SELECT eid, k, ts, weight FROM q JOIN ww ON node = src AND ts < t), a AS (SELECT eid, k, sum(weight) AS w FROM r GROUP BY ALL)
SELECT eid, k, ts, count(*) AS n, round(sum(weight) / any_value(w), 6) AS chance FROM r JOIN a USING (eid, k) GROUP BY ALL""")
def interval_weights(spark, d):
    """Chances of a time-aware draw, by time."""
    events, q = _graph(spark, d)
    return _rounded(N.interval_chances(written(N.interval_weights(events, 0.2), "weighed"), q), "chance")


@query(f"""WITH {_EDGES}, {_WEIGHED}, a AS (SELECT node, t, count(*) AS n FROM (SELECT DISTINCT src AS node, t FROM q) JOIN adj USING (node) WHERE ts < t GROUP BY ALL),
s AS (SELECT q.eid, q.k, src AS node, d, {draw_sql("eid", "d + k * 31", "2147483647")} / 2147483647.0::DOUBLE * u.upto AS point FROM q JOIN a ON a.node = src AND a.t = q.t JOIN wu u ON u.node = src AND u.seq = n, (SELECT unnest([0, 1, 2, 3, 4]) AS d)),
f AS (SELECT s.eid, s.k, d, w.seq, w.nbr, w.ts FROM s JOIN wu w ON w.node = s.node AND w.upto > point AND w.upto - w.weight <= point QUALIFY row_number() OVER (PARTITION BY s.eid, s.k, d ORDER BY w.seq) = 1)
SELECT eid, k, row_number() OVER (PARTITION BY eid, k ORDER BY ts, seq, d) - 1 AS slot, nbr, ts FROM f""")
def interval_draws(spark, d):
    """Five time-aware draws from each source's history, with replacement, in the order of time."""
    events, q = _graph(spark, d)
    return N.interval_draws(written(N.interval_weights(events, 0.2), "weighed"), q, 5)
