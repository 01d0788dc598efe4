"""Registered queries of the histories of a query's ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import history as H
from chronoweft.operators import splits as P
from chronoweft.plans.reference import _EDGES, _VECTORS, _graph, _rounded, _vectors, query
from chronoweft.operators import semantic as V
from chronoweft.sources import tables as D
from chronoweft.sources.written import written

_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, aeid, role DESC) AS seq FROM adj)"


def _last(end: str, size: int, name: str = "h", of: str = "q") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT eid, k, node, nbr, role, s.r, s.ts, row_number() OVER (PARTITION BY eid, k ORDER BY s.seq DESC) - 1 AS age, t FROM {of} JOIN seq s ON s.node = {end} AND s.ts < t) WHERE age < {size})"""


def _seq(spark, d):
    events, q = _graph(spark, d)
    return written(H.numbered_events(events), "numbered"), q


@query(f"WITH {_EDGES}, {_SEQ}, {_last('src', 10)} SELECT eid, k, age, node, nbr, role, r, ts FROM h")
def endpoint_history_source(spark, d):
    return H.endpoint_history(*_seq(spark, d), "src", 10)


@query(f"WITH {_EDGES}, {_SEQ}, {_last('tgt', 10)} SELECT eid, k, age, node, nbr, role, r, ts FROM h")
def endpoint_history_target(spark, d):
    return H.endpoint_history(*_seq(spark, d), "tgt", 10)


@query(f"WITH {_EDGES}, {_SEQ}, {_last('src', 50)} SELECT eid, k, age, node, nbr, role, r, ts FROM h WHERE ts >= t - 180")
def history_pool(spark, d):
    return H.endpoint_history(*_seq(spark, d), "src", 50, reach=180)


@query(f"""WITH {_EDGES}, m AS (SELECT eid, k, e.u, e.r, e.i, e.ts, row_number() OVER (PARTITION BY q.eid, k ORDER BY e.ts DESC, e.eid DESC) - 1 AS age
FROM q JOIN (SELECT eid AS e_id, * EXCLUDE (eid), eid FROM edges) e ON least(e.u, e.i) = least(src, tgt) AND greatest(e.u, e.i) = greatest(src, tgt) AND e.ts < t) SELECT eid, k, age, u, r, i, ts FROM m WHERE age < 5""".replace("SELECT eid, k, e.u", "SELECT q.eid, k, e.u"))
def mutual_history(spark, d):
    events, q = _graph(spark, d)
    return H.mutual_history(events, q, 5)


@query(f"""WITH {_EDGES}, x AS (SELECT eid, k, nbr, role, ts, row_number() OVER (PARTITION BY eid, k, nbr ORDER BY role, ts DESC) AS n FROM q JOIN adj ON node = src AND ts < t WHERE k = 0)
SELECT eid, k, nbr, role, ts FROM x WHERE n = 1""")
def latest_neighbor_event(spark, d):
    events, q = _graph(spark, d)
    return H.latest_neighbor_events(events, q.where("k = 0"), "src")


@query(f"""WITH {_EDGES}, fc AS (SELECT node, nbr, min(ts) AS first_ts FROM adj GROUP BY ALL), pairs AS (SELECT DISTINCT src, tgt, t FROM q),
c AS (SELECT p.*, a.nbr FROM pairs p JOIN fc a ON a.node = p.src AND a.first_ts < p.t JOIN fc b ON b.node = p.tgt AND b.nbr = a.nbr AND b.first_ts < p.t WHERE a.nbr <> src AND a.nbr <> tgt),
deg AS (SELECT c.nbr, c.t, count(*) AS degree FROM (SELECT DISTINCT nbr, t FROM c) c JOIN adj ON adj.node = c.nbr AND adj.ts < c.t GROUP BY ALL),
w AS (SELECT c.*, degree, row_number() OVER (PARTITION BY src, tgt, c.t ORDER BY degree, c.nbr) - 1 AS place FROM c JOIN deg ON deg.nbr = c.nbr AND deg.t = c.t)
SELECT eid, k, place, nbr, degree FROM q JOIN w USING (src, tgt, t) WHERE place < 5""")
def common_neighbor_rows(spark, d):
    events, q = _graph(spark, d)
    return H.common_neighbor_rows(events, q, 5)


@query(f"WITH {_EDGES} SELECT eid, k, nbr, ts FROM q JOIN adj ON node = src AND ts < t WHERE k = 0")
def first_hop(spark, d):
    events, q = _graph(spark, d)
    return H.first_hop(events, q.where("k = 0"))


@query(f"""WITH {_EDGES}, {_SEQ}, {_last('src', 20, 'a')}, {_last('tgt', 20, 'b')},
ab AS (SELECT eid, k, count(*) AS n, max(a.ts) AS m FROM a JOIN q USING (eid, k) WHERE a.nbr = tgt GROUP BY ALL), ba AS (SELECT eid, k, count(*) AS n, max(b.ts) AS m FROM b JOIN q USING (eid, k) WHERE b.nbr = src GROUP BY ALL),
dg AS (SELECT eid, k, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT DISTINCT eid, k, nbr, t FROM a SEMI JOIN b USING (eid, k, nbr) WHERE nbr > 0),
cd AS (SELECT x.nbr, x.t, count(*) AS d FROM (SELECT DISTINCT nbr, t FROM c) x JOIN adj ON adj.node = x.nbr AND adj.ts < x.t GROUP BY ALL),
ra AS (SELECT eid, k, sum(1.0 / least(d, 20)) AS ra FROM c JOIN cd USING (nbr, t) GROUP BY ALL)
SELECT eid, k, coalesce(CAST(greatest(coalesce(ab.m, ba.m), coalesce(ba.m, ab.m)) AS DOUBLE), -1e15) AS last, CAST(coalesce(dg.n, 0) AS INTEGER) AS degree,
  CAST(greatest(coalesce(ab.n, 0), coalesce(ba.n, 0)) AS INTEGER) AS pairs, round(coalesce(ra, 0), 6) AS ra FROM q LEFT JOIN ab USING (eid, k) LEFT JOIN ba USING (eid, k) LEFT JOIN dg USING (eid, k) LEFT JOIN ra USING (eid, k)""")
def score_recent_four_pack(spark, d):
    return _rounded(H.recent_four_pack(*_graph(spark, d), 20), "ra")


@query(f"""WITH {_EDGES}, {_SEQ}, p AS (SELECT * FROM q), {_last('src', 10, 'a', 'p')}, {_last('tgt', 10, 'b', 'p')}, s AS (SELECT 'src' AS side, * FROM a UNION ALL SELECT 'tgt', * FROM b),
w AS (SELECT *, row_number() OVER (PARTITION BY eid, k, side ORDER BY age DESC) - 1 AS place FROM s)
SELECT w.eid, w.k, w.side, CAST(place AS INTEGER) AS place, w.nbr, CAST(count(*) FILTER (s.side = w.side) AS INTEGER) AS own, CAST(count(*) FILTER (s.side <> w.side) AS INTEGER) AS other
FROM w JOIN s ON s.eid = w.eid AND s.k = w.k AND s.nbr = w.nbr GROUP BY ALL""")
def neighbor_co_occurrence(spark, d):
    events, q = _graph(spark, d)
    return H.co_occurrence(events, q, 10)


def _hop(asked: str) -> str:
    return f"SELECT * FROM (SELECT a.node, a.seen, s.nbr, s.ts, row_number() OVER (PARTITION BY a.node, a.seen ORDER BY s.seq DESC) AS n FROM (SELECT DISTINCT node, seen FROM {asked}) a JOIN seq s ON s.node = a.node AND s.ts < a.seen) WHERE n <= 5"


@query(f"""WITH {_EDGES}, {_SEQ}, w0 AS (SELECT eid, k, 'src' AS root, src AS node, t AS seen, 1 AS m FROM q UNION ALL SELECT eid, k, 'tgt', tgt, t, 1 FROM q),
r1 AS ({_hop("w0")}), w1 AS (SELECT eid, k, root, nbr AS node, ts AS seen, sum(m) AS m FROM w0 JOIN r1 USING (node, seen) GROUP BY ALL),
r2 AS ({_hop("w1")}), w2 AS (SELECT eid, k, root, nbr AS node, ts AS seen, sum(m) AS m FROM w1 JOIN r2 USING (node, seen) GROUP BY ALL)
SELECT eid, k, root, CAST(0 AS INTEGER) AS hop, node, CAST(1 AS DOUBLE) AS share FROM w0 UNION ALL SELECT eid, k, root, 1, node, round(sum(m) / 5, 6) FROM w1 GROUP BY ALL UNION ALL SELECT eid, k, root, 2, node, round(sum(m) / 25, 6) FROM w2 GROUP BY ALL""")
def walk_appearances(spark, d):
    seq, q = _seq(spark, d)
    return _rounded(H.walk_appearances(seq, written(q, "queries"), 5, 2), "share")


@query(f"""WITH {_EDGES}, {_SEQ}, p AS (SELECT * FROM q WHERE k = 0), {_last('src', 6, 'a', 'p')}, n AS (SELECT eid, k, src, (SELECT count(*) FROM a WHERE a.eid = p.eid) AS n FROM p),
x AS (SELECT eid, k, 0 AS pos, src AS node FROM n UNION ALL SELECT eid, k, row_number() OVER (PARTITION BY eid, k ORDER BY age DESC), nbr FROM a
UNION ALL SELECT eid, k, unnest(range(n + 1, ((n + 4) // 4) * 4)), 0 FROM n)
SELECT eid, k, CAST(pos // 4 AS BIGINT) AS patch, CAST(pos % 4 AS INTEGER) AS place, node FROM x""")
def sequence_patches(spark, d):
    seq, q = _seq(spark, d)
    q = q.where("k = 0")
    return H.patches(H.recent_sequences(seq, q, "src", 10, "a"), "a", 7, 4)


_RECENT = """hist AS (SELECT edges.* FROM edges, cuts WHERE ts <= test_time AND ts > test_time - 45),
one AS (SELECT DISTINCT row, col FROM (SELECT u AS row, i AS col FROM hist UNION ALL SELECT i, u FROM hist) WHERE row <> col)"""
_TWO = "two AS (SELECT DISTINCT a.row, b.col FROM one a JOIN one b ON a.col = b.row WHERE a.row <> b.col AND NOT EXISTS (SELECT 1 FROM one c WHERE c.row = a.row AND c.col = b.col))"


def _recent(spark, d):
    """The adjacency of the last 45 days before the test split, and the queries."""
    events, q = _graph(spark, d)
    _, test_time = P.boundaries(events)
    return written(H.history_adjacency(P.recency_cutoff(events.where(F.col("ts") <= test_time), test_time - 44)), "adjacent"), q


@query(f"WITH {_EDGES}, {_RECENT} SELECT row, col FROM one")
def history_adjacency(spark, d):
    return _recent(spark, d)[0]


@query(f"WITH {_EDGES}, {_RECENT}, {_TWO} SELECT row, col FROM two")
def two_hop_adjacency(spark, d):
    return H.two_hop(_recent(spark, d)[0])


@query(f"""WITH {_EDGES}, {_RECENT}, {_TWO}, p AS (SELECT DISTINCT src, tgt FROM q),
c11 AS (SELECT src, tgt, count(*) AS n FROM p JOIN one a ON a.row = src JOIN one b ON b.row = tgt AND b.col = a.col GROUP BY ALL), c12 AS (SELECT src, tgt, count(*) AS n FROM p JOIN one a ON a.row = src JOIN two b ON b.row = tgt AND b.col = a.col GROUP BY ALL),
c21 AS (SELECT src, tgt, count(*) AS n FROM p JOIN two a ON a.row = src JOIN one b ON b.row = tgt AND b.col = a.col GROUP BY ALL), c22 AS (SELECT src, tgt, count(*) AS n FROM p JOIN two a ON a.row = src JOIN two b ON b.row = tgt AND b.col = a.col GROUP BY ALL),
d1 AS (SELECT row, count(*) AS n FROM one GROUP BY row), d2 AS (SELECT row, count(*) AS n FROM two GROUP BY row),
s AS (SELECT p.src, p.tgt, coalesce(c11.n, 0) AS a, coalesce(c12.n, 0) + coalesce(c21.n, 0) AS m, coalesce(c22.n, 0) AS b, coalesce(x.n, 0) + coalesce(y.n, 0) AS e1, coalesce(v.n, 0) + coalesce(w.n, 0) AS e2
FROM p LEFT JOIN c11 USING (src, tgt) LEFT JOIN c12 USING (src, tgt) LEFT JOIN c21 USING (src, tgt) LEFT JOIN c22 USING (src, tgt) LEFT JOIN d1 x ON x.row = src LEFT JOIN d1 y ON y.row = tgt LEFT JOIN d2 v ON v.row = src LEFT JOIN d2 w ON w.row = tgt)
SELECT eid, k, round(ln(1 + a), 6) AS both_1, round(ln(1 + m), 6) AS mixed, round(ln(1 + b), 6) AS both_2, round(ln(1 + greatest(e1 - 2 * a - m, 0)), 6) AS rest_1, round(ln(1 + greatest(e2 - 2 * b - m, 0)), 6) AS rest_2 FROM q JOIN s USING (src, tgt)""")
def score_shared_counts(spark, d):
    one, q = _recent(spark, d)
    return _rounded(H.shared_counts(one, written(H.two_hop(one), "two"), q), "both_1", "mixed", "both_2", "rest_1", "rest_2")


@query(f"""WITH {_EDGES}, {_RECENT}, o AS (SELECT DISTINCT u AS row, i AS col FROM edges, cuts WHERE ts <= test_time - 45 AND u <> i), b AS (SELECT row, col FROM one)
SELECT 'shared' AS part, count(*) AS n FROM (FROM b INTERSECT FROM o) UNION ALL SELECT 'only_recent', count(*) FROM (FROM b EXCEPT FROM o)""")
def adjacency_overlap(spark, d):
    """Pairs of the recent adjacency that the older, directed one has too, and those that it lacks."""
    events, _ = _graph(spark, d)
    _, test_time = P.boundaries(events)
    recent, old = _recent(spark, d)[0], H.history_adjacency(events.where(F.col("ts") <= test_time - 45), symmetric=False)
    part = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return part(recent.intersect(old), "shared").union(part(recent.subtract(old), "only_recent"))


@query(f"""WITH {_EDGES}, p AS (SELECT u, i AS partner, count(*) AS n, max(ts) AS last_ts FROM edges GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, last_ts DESC, partner) AS a, row_number() OVER (PARTITION BY u ORDER BY last_ts DESC, n DESC, partner) AS b FROM p) SELECT u, partner, n, last_ts FROM w WHERE a <= 5 OR b <= 5""")
def salient_partners(spark, d):
    return H.salient_partners(D.edges(spark, d))


@query(f"""WITH {_EDGES}, {_SEQ}, {_VECTORS}, p AS (SELECT * FROM q), {_last('src', 30, 'h', 'p')},
s AS (SELECT h.eid, h.k, age, h.nbr, CAST(h.t - h.ts AS DOUBLE) AS gap, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 9) AS similarity FROM h JOIN p USING (eid, k) LEFT JOIN vectors a ON a.node = h.nbr LEFT JOIN vectors b ON b.node = tgt),
m AS (SELECT eid, k, quantile_cont(gap, 0.5) AS tau, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT s.*, n, exp(-1.0 * gap / greatest(tau, 1)) AS fresh FROM s JOIN m USING (eid, k)),
v AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE 0.5 * (1 - (row_number() OVER (PARTITION BY eid, k ORDER BY similarity DESC, age) - 1) / (n - 1)) + 0.5 * (1 - (row_number() OVER (PARTITION BY eid, k ORDER BY fresh DESC, age) - 1) / (n - 1)) END AS value FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY eid, k ORDER BY CASE WHEN age < 2 THEN 0 ELSE 1 END, round(value, 9) DESC, age) - 1 AS place FROM v) SELECT eid, k, CAST(place AS INTEGER) AS place, age, nbr, round(value, 6) AS value FROM w WHERE place < 8""")
def ranked_history(spark, d):
    """Of the source's pool the events nearest to the target in meaning and time."""
    seq, q = _seq(spark, d)
    unit = _vectors(spark, d).select("node", V.normalise(F.col("vector").cast("array<double>")).alias("v"))
    out = H.history_by_likeness(seq, written(q, "queries"), unit, 30, 1.0, 0.5, 8, 2)
    return _rounded(out.select("eid", "k", "place", "age", "nbr", "value"), "value")


@query(f"""WITH {_EDGES}, n AS (SELECT node, ln(1 + count(*) FILTER (role = 'in')) AS in_degree, ln(1 + count(*) FILTER (role = 'out')) AS out_degree, ln(1 + count(*)) AS degree FROM adj GROUP BY node)
SELECT node, {", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) ELSE 0 END AS {c}" for c in ("in_degree", "out_degree", "degree"))} FROM n""")
def structural_seeds(spark, d):
    return _rounded(H.structural_seeds(D.edges(spark, d)), "in_degree", "out_degree", "degree")


@query(f"""WITH {_EDGES}, w AS (SELECT node, role, r, sum(exp(-0.01 * (11000 - ts))) AS w FROM adj WHERE ts < 11000 GROUP BY ALL) SELECT node, role, r, round(w / sum(w) OVER (PARTITION BY node, role), 6) AS weight FROM w""")
def relation_context(spark, d):
    return _rounded(H.relation_context(D.edges(spark, d), 11000, 0.01), "weight")


@query(f"""WITH {_EDGES}, {_VECTORS}, o AS (SELECT node, nbr, ts, role, row_number() OVER (PARTITION BY node, role ORDER BY ts, aeid) AS seq FROM adj), a AS (SELECT DISTINCT tgt, t FROM q),
n AS (SELECT a.tgt, a.t, role, count(*) AS n FROM a JOIN o ON node = tgt AND ts < t GROUP BY ALL), e AS (SELECT q.eid, q.k, q.src, o.nbr AS entity, o.ts FROM q JOIN n USING (tgt, t) JOIN o ON o.node = q.tgt AND o.role = n.role AND o.seq > n.n - 20 AND o.seq <= n.n),
s AS (SELECT eid, k, any_value(src) AS src, entity, list(ts ORDER BY ts) AS times FROM e GROUP BY eid, k, entity), r AS (SELECT s.*, round(coalesce(list_cosine_similarity(x.v, y.v), 0), 9) AS score FROM s LEFT JOIN vectors x ON x.node = s.src LEFT JOIN vectors y ON y.node = s.entity),
w AS (SELECT *, row_number() OVER (PARTITION BY eid, k ORDER BY times[-1] DESC, score DESC, len(times) DESC, times[1], entity) - 1 AS place FROM r)
SELECT eid, k, CAST(place AS INTEGER) AS place, entity, round(score, 6) AS score, array_to_string([CAST(x AS VARCHAR) FOR x IN times], ',') AS times FROM w WHERE place < 6""")
def entity_series(spark, d):
    """The target's earlier events as series by the other entity, the six of the latest times."""
    events, q = _graph(spark, d)
    unit = _vectors(spark, d).select("node", V.normalise(F.col("vector").cast("array<double>")).alias("v"))
    out = H.entity_series(events, written(q, "queries"), unit, 20, 6)
    return _rounded(out.withColumn("times", F.array_join(F.transform("times", lambda x: x.cast("string")), ",")), "score")
