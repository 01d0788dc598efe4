"""Vector scorers over time: profiles of histories, smoothing in time windows, propagation, projections, and pairwise fits.

Vectors (node, vector) are scaled to length 1 first. Sums of vectors are made by dimension or by running sums of some dimensions each, so no group holds a node's history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.asof import asof_aggregate
from chronoweft.operators.prefix import numbers_within
from chronoweft.operators.scorers import KEY
from chronoweft.operators.semantic import dot, normalise
from chronoweft.sources.tables import adjacency, draw
from chronoweft.sources.written import written

#: Components of a vector that one row of a running sum holds.
WIDE = 32


def units(vectors: DataFrame) -> DataFrame:
    return vectors.select("node", normalise(F.col("vector").cast("array<double>")).alias("v"))


def as_vectors(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, v: vectors of (keys, dim, x) rows, one for each dimension."""
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))


def _named(v: DataFrame, node: str, name: str) -> DataFrame:
    return v.withColumnsRenamed({"node": node, "v": name})


def _lengths(vectors: DataFrame) -> DataFrame:
    """node, v, norm: vectors in the type they came in, which moves as fewer bytes than scaled doubles, and what to divide them by."""
    wide = F.col("vector").cast("array<double>")
    return vectors.select("node", F.col("vector").alias("v"), F.sqrt(dot(wide, wide)).alias("norm")).withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))


def _scaled(v: str, norm: str) -> Column:
    return F.transform(F.col(v).cast("array<double>"), lambda x: x / F.col(norm))


def _pieces(v: DataFrame) -> DataFrame:
    """node, part, v, norm: ``WIDE`` components of ``_lengths`` in a row."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / WIDE).cast("int")), lambda p: F.slice("v", p * WIDE + 1, WIDE))
    return v.where(F.size("v") > 0).select("node", F.posexplode(cut).alias("part", "v"), "norm")


def _component(d: int) -> Column:
    return F.get("v", F.lit(d)).cast("double") / F.col("norm")


def _whole(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, v: vectors, scaled to length 1, of (keys, part, x0, x1, ...); none where there are no components."""
    parts = sums.select(*keys, "part", F.array_compact(F.array(*(f"x{d}" for d in range(WIDE)))).alias("x")).where(F.size("x") > 0)
    return parts.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "x"))), lambda p: p["x"])).alias("v")).select(*keys, normalise(F.col("v")).alias("v"))


def history_profile(events: DataFrame, q: DataFrame, vectors: DataFrame) -> DataFrame:
    """eid, k, score: product of the target's vector and the scaled mean of the source's neighbours' before t (events count); without any, the
    source's own vector; 0 without one, or without the target's.

    Only queries whose target has a vector meet any."""
    v = written(_lengths(vectors), "lengths")
    ids = v.select("node")
    hit = ids.distinct().select(F.col("node").alias("tgt"), F.lit(True).alias("_hit"))
    marked = written(q.select(*KEY, "src", "tgt", "t").join(hit, "tgt", "left"), "marked")
    hits = marked.where("_hit").drop("_hit")
    asked = written(hits.select(F.col("src").alias("node"), "t").distinct(), "asked")
    parts = -(-(v.agg(F.max(F.size("v"))).first()[0] or 0) // WIDE)
    told = adjacency(events).select("node", "nbr", "ts").join(ids.withColumnRenamed("node", "nbr"), "nbr", "left_semi").join(asked.select("node").distinct(), "node", "left_semi")
    told = told.join(_named(_pieces(v), "nbr", "v"), "nbr").select("node", "part", "ts", "v", "norm")
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, parts - 1)))))
    sums = asof_aggregate(told, spread, ["node", "part"], {f"x{d}": ("sum", _component(d)) for d in range(WIDE)})
    profile = _whole(sums, ["node", "t"]).withColumnsRenamed({"node": "src", "v": "p"})
    b = v.withColumnsRenamed({"node": "tgt", "v": "b", "norm": "b_norm"})
    score = lambda a: F.coalesce(dot(a, _scaled("b", "b_norm")), F.lit(0.0)).alias("score")
    scored = written(hits.join(b, "tgt").join(profile, ["src", "t"], "left").select(*KEY, "src", "tgt", score(F.col("p")), F.col("p").isNull().alias("bare")), "scored")
    bare = scored.where("bare").select(*KEY, "src", "tgt").join(v.withColumnsRenamed({"node": "src", "v": "own"}), "src", "left").join(b, "tgt").select(*KEY, score(_scaled("own", "norm")))
    return marked.where("_hit is null").select(*KEY, F.lit(0.0).alias("score")).unionByName(scored.where("not bare").select(*KEY, "score")).unionByName(bare)


def conditioned_profile(events: DataFrame, q: DataFrame, vectors: DataFrame, temperature: float = 0.2) -> DataFrame:
    """The same with the neighbours weighted by the softmax of their products with the target over ``temperature``."""
    v = units(vectors)
    asked = q.select(*KEY, "src", "tgt", "t").join(_named(v, "tgt", "b"), "tgt")
    met = asked.join(adjacency(events).select(F.col("node").alias("src"), "nbr", "ts"), "src").where("ts < t").groupBy(*KEY, "nbr").agg(F.count("*").alias("n"))
    near = met.join(_named(v, "nbr", "h"), "nbr").join(asked.select(*KEY, "b"), KEY).withColumn("x", dot("h", "b") / max(temperature, 1e-6))
    w = Window.partitionBy(*KEY)
    near = near.withColumn("e", F.col("n") * F.exp(F.col("x") - F.max("x").over(w)))
    sums = near.select(*KEY, "e", F.posexplode("h").alias("dim", "y")).groupBy(*KEY, "dim").agg(F.sum(F.col("e") * F.col("y")).alias("x"))
    profile = as_vectors(sums, KEY).select(*KEY, normalise(F.col("v")).alias("p"))
    out = q.join(profile, KEY, "left").join(_named(v, "src", "own"), "src", "left").join(_named(v, "tgt", "b"), "tgt", "left")
    return out.select(*KEY, F.coalesce(dot(F.coalesce("p", "own"), F.col("b")), F.lit(0.0)).alias("score"))


def window_pairs(events: DataFrame, v: DataFrame, reference: float, window: float, decay: float = 0.0, top: int | None = None, mode: str = "union", cover: bool = False, least: float | None = None, keep: float = 0.0) -> DataFrame:
    """node, nbr, w: the events of [reference - window, reference] between nodes with vectors (node, v: scaled), an event weighing exp(-decay * age), summed by pair.

    Without ``top`` every event counts in both directions. ``union``: those that are among the last ``top`` of their source as such or of their target as such, in both directions; with ``cover`` also the last event of every
    node that is left without one. ``per_node``: for each node its own last ``top`` in either role, in its own direction only. Ties of time go to the larger eid. Pairs whose cosine is below ``least`` weigh
    ``keep`` times as much; 0 leaves them out."""
    ids = v.select("node")
    here = events.where(F.col("ts").between(reference - window, reference)).join(ids.withColumnRenamed("node", "u"), "u", "left_semi").join(ids.withColumnRenamed("node", "i"), "i", "left_semi")
    latest = [F.desc("ts"), F.desc("eid")]
    if top is None:
        rows = adjacency(here)
    elif mode == "union":
        here = written(here, "window-events")
        chosen = [numbers_within(here.select(end, "ts", "eid"), [end], latest, "n").where(F.col("n") <= top).select("eid") for end in ("u", "i")]
        kept = written(here.join(chosen[0].union(chosen[1]).distinct(), "eid", "left_semi"), "latest-events")
        if cover:
            bare = adjacency(here).join(adjacency(kept).select("node").distinct(), "node", "left_anti")
            kept = kept.unionByName(here.join(bare.groupBy("node").agg(F.max_by("eid", F.struct("ts", "eid")).alias("eid")).select("eid").distinct(), "eid", "left_semi"))
        rows = adjacency(kept)
    elif mode == "per_node":
        rows = numbers_within(adjacency(here), ["node"], [*latest, F.desc("role")], "n").where(F.col("n") <= top)
    else:
        raise ValueError("mode is union or per_node")
    pairs = rows.groupBy("node", "nbr").agg(F.sum(F.exp(-decay * (F.lit(reference) - F.col("ts")))).alias("w"))
    if least is None:
        return pairs
    near = pairs.join(_named(v, "node", "a"), "node").join(_named(v, "nbr", "b"), "nbr").withColumn("low", F.round(dot("a", "b"), 9) < least)
    return near.where(~F.col("low") | F.lit(keep > 0)).select("node", "nbr", F.when(F.col("low"), keep * F.col("w")).otherwise(F.col("w")).alias("w"))


def smooth_window(events: DataFrame, vectors: DataFrame, reference: float, window: float, steps: int = 1, decay: float = 0.0, residual: float = 0.0, symmetric: bool = True, dampen: bool = False, **choice) -> DataFrame:
    """node, v: ``steps`` of D^-1/2 (A + I) D^-1/2 (not ``symmetric``: D^-1 (A + I)) over the pairs of ``window_pairs`` with the further options ``choice``; ``dampen``: ln(1 + w) of the weights,
    the loops' included; ``residual`` parts of the start are kept; scaled to length 1."""
    v = units(vectors)
    start = v.select("node", F.posexplode("v").alias("dim", "x"))
    ids = v.select("node")
    pairs = window_pairs(events, v, reference, window, decay, **choice)
    pairs = pairs.union(ids.select("node", F.col("node").alias("nbr"), F.lit(1.0))).groupBy("node", "nbr").agg(F.sum("w").alias("w"))
    if dampen:
        pairs = pairs.withColumn("w", F.log1p("w"))
    degree = pairs.groupBy("node").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("d"))
    scaled = pairs.join(degree, "node").join(degree.withColumnsRenamed({"node": "nbr", "d": "e"}), "nbr")
    norm = F.sqrt(F.col("d") * F.col("e")) if symmetric else F.col("d")
    scaled = written(scaled.select("node", "nbr", (F.col("w") / norm).alias("w")), "window")
    x = start
    for _ in range(steps):
        moved = scaled.join(x.withColumnRenamed("node", "nbr"), "nbr").groupBy("node", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        x = moved if not residual else moved.join(start.withColumnRenamed("x", "x0"), ["node", "dim"]).select("node", "dim", ((1 - residual) * F.col("x") + residual * F.col("x0")).alias("x"))
        x = written(x, "step")
    return as_vectors(x, ["node"]).select("node", normalise(F.col("v")).alias("v"))


def blend_scores(q: DataFrame, raw: DataFrame, smooth: DataFrame, a: float, g: float) -> DataFrame:
    """eid, k, score: cosine of (1 - a) raw + a smooth of the source and (1 - g) raw + g smooth of the target (node, v each); 0 if one is missing."""
    both = raw.join(smooth.withColumnRenamed("v", "s"), "node")
    mix = lambda share, name, node: both.select(F.col("node").alias(node), normalise(F.zip_with("v", "s", lambda x, y: (1 - share) * x + share * y)).alias(name))
    out = q.join(mix(a, "x", "src"), "src", "left").join(mix(g, "y", "tgt"), "tgt", "left")
    return out.select(*KEY, F.coalesce(dot("x", "y"), F.lit(0.0)).alias("score"))


def smoothed_at_time(events: DataFrame, q: DataFrame, vectors: DataFrame, window: float) -> DataFrame:
    """eid, k, score: product of the two ends' vectors after one smoothing step over the events of [t - window, t), which is made for the nodes
    and times of queries with two vectors alone; -1 where an end has no vector."""
    v = written(_lengths(vectors), "lengths")
    ids = v.select("node").distinct()
    marked = q.select(*KEY, "src", "tgt", "t")
    for end in ("src", "tgt"):
        marked = marked.join(ids.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    marked = written(marked.withColumn("_both", F.coalesce(F.col("_src") & F.col("_tgt"), F.lit(False))).drop("_src", "_tgt"), "marked")
    both = marked.where("_both").drop("_both")
    told = adjacency(events).select("node", "nbr", "ts").join(ids, "node", "left_semi").join(ids.withColumnRenamed("node", "nbr"), "nbr", "left_semi")
    told = written(told, "told")
    asked = written(both.select("t", F.explode(F.array("src", "tgt")).alias("node")).distinct(), "asked")
    # only stretches of time that a window reaches into are met
    stretch = lambda c: F.floor(c / (window if window > 0 else 1))
    reach = asked.withColumn("_at", F.explode(F.sequence(stretch(F.col("t") - window), stretch(F.col("t")))))
    near = reach.join(told.withColumn("_at", stretch(F.col("ts"))), ["node", "_at"]).where((F.col("ts") < F.col("t")) & (F.col("ts") >= F.col("t") - window))
    near = written(near.groupBy("node", "t", "nbr").agg(F.count("*").alias("w")), "near")
    need = near.select(F.col("nbr").alias("node"), "t").union(asked.select("node", "t")).distinct()
    ends = need.select("node", "t", F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("t") - window).alias("at"), F.lit(-1).alias("sign")))).alias("x")).select("node", "t", "x.*")
    counts = asof_aggregate(told.select("node", "ts"), ends.select("node", F.col("at")), ["node"], {"n": ("count", F.col("ts"))}, t="at")
    degree = written(ends.join(counts, ["node", "at"]).groupBy("node", "t").agg((1 + F.sum(F.col("n") * F.col("sign"))).cast("double").alias("d")), "degree")
    rows = near.unionByName(asked.select("node", "t", F.col("node").alias("nbr"), F.lit(1).cast("long").alias("w")))
    rows = rows.join(degree, ["node", "t"]).join(degree.withColumnsRenamed({"node": "nbr", "d": "e"}), ["nbr", "t"]).join(_named(_pieces(v), "nbr", "v"), "nbr")
    rows = rows.select("node", "t", "part", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"), "v", "norm")
    sums = rows.groupBy("node", "t", "part").agg(*(F.sum(F.col("w") * _component(d)).alias(f"x{d}") for d in range(WIDE)))
    at = written(_whole(sums, ["node", "t"]), "smoothed")
    out = both.join(_named(at, "src", "a"), ["src", "t"], "left").join(_named(at, "tgt", "b"), ["tgt", "t"], "left").select(*KEY, F.coalesce(dot("a", "b"), F.lit(-1.0)).alias("score"))
    return out.unionByName(marked.where("not _both").select(*KEY, F.lit(-1.0).alias("score")))


def propagate(adjacent: DataFrame, vectors: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """node, v: (1 + epsilon) h + sum of the neighbours' h over an adjacency (row, col), scaled to length 1."""
    dims = units(vectors).select("node", F.posexplode("v").alias("dim", "x"))
    told = adjacent.join(dims.withColumnRenamed("node", "col"), "col").select(F.col("row").alias("node"), "dim", "x").join(dims.select("node").distinct(), "node", "left_semi")
    total = dims.select("node", "dim", ((1 + epsilon) * F.col("x")).alias("x")).union(told).groupBy("node", "dim").agg(F.sum("x").alias("x"))
    return as_vectors(total, ["node"]).select("node", normalise(F.col("v")).alias("v"))


def project(vectors: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """node, dim, x: ``size`` sums of the components with drawn signs over the root of ``size``; the signs are a rule of the two dimensions."""
    parts = vectors.select("node", F.posexplode(F.col("vector").cast("array<double>")).alias("j", "x")).withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    sign = 1 - 2 * draw(F.col("j"), F.col("dim"), F.lit(2), seed)
    return parts.groupBy("node", "dim").agg((F.sum(F.col("x") * sign) / F.sqrt(F.lit(float(size)))).alias("x"))


def recent_attention(seq: DataFrame, q: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """eid, k, v: softmax-weighted mean of the vectors of the source's last ``size`` neighbours, by their products with the source's own vector over the
    root of the length; the own vector without any."""
    from chronoweft.operators.history import endpoint_history

    v = units(vectors)
    last = endpoint_history(seq, q, "src", size).select(*KEY, "age", "nbr").join(_named(v, "nbr", "h"), "nbr")
    own = q.select(*KEY, "src").join(_named(v, "src", "own"), "src")
    near = last.join(own, KEY).withColumn("x", dot("h", "own") / F.sqrt(F.size("own").cast("double")))
    w = Window.partitionBy(*KEY)
    near = near.withColumn("e", F.exp(F.col("x") - F.max("x").over(w))).withColumn("e", F.col("e") / F.sum("e").over(w))
    sums = near.select(*KEY, "e", F.posexplode("h").alias("dim", "y")).groupBy(*KEY, "dim").agg(F.sum(F.col("e") * F.col("y")).alias("x"))
    return own.join(as_vectors(sums, KEY), KEY, "left").select(*KEY, F.coalesce("v", "own").alias("v"))


def pair_gram(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """a, b, g, d: sums over the pairs of a query's positive and negatives of the products of their differences in two features, and (where a = b)
    of the differences themselves."""
    pos = {f: F.max(F.when(F.col("k") == 0, F.col(f))).over(Window.partitionBy("eid")) for f in features}
    diffs = rows.withColumns({f"_{f}": pos[f] - F.col(f) for f in features}).where("k > 0")
    aggs = [F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"g_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)] + [F.sum(f"_{a}").alias(f"d_{i}") for i, a in enumerate(features)]
    one = diffs.agg(*aggs)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"g_{i}_{j}").cast("double").alias("g"), (F.col(f"d_{i}") if i == j else F.lit(None)).cast("double").alias("d")) for i, a in enumerate(features) for j, b in enumerate(features)]
    return one.select(F.inline(F.array(*cells)))


def pairwise_ridge(rows: DataFrame, features: Sequence[str], strength: float = 1.0) -> dict[str, float]:
    """Weights w of (G / (s s') + strength I) (w s) = r / s for the sums G and r of ``pair_gram``, s the roots of its diagonal."""
    import numpy as np

    got = {(r["a"], r["b"]): r for r in pair_gram(rows, features).collect()}
    gram = np.array([[got[a, b]["g"] for b in features] for a in features])
    right = np.array([got[a, a]["d"] for a in features])
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    w = np.linalg.solve(gram / np.outer(scale, scale) + strength * np.eye(len(features)), right / scale) / scale
    return dict(zip(features, w.tolist()))


def log_features(scores: DataFrame) -> DataFrame:
    """The scorers' columns as features: recencies as -ln(1 + time since), counts as ln(1 + n), a pair never seen as 1e9 ago."""
    since = lambda c: -F.log1p(F.when(F.col(c) <= -1e14, 1e9).otherwise(-F.col(c)))
    known: dict[str, Column] = {c: since(c) for c in ("recency", "global_recency")} | {c: F.log1p(F.col(c).cast("double")) for c in ("popularity", "recent_degree", "past")}
    return scores.withColumns({c: known[c] for c in scores.columns if c in known})


