"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds.

Vectors are scaled to length 1 and turned into the axes of the second moments of all vectors of their number of components,
largest first. Rows sorted by label, number of components and leading axes are cut into tiles; two tiles of a label are compared
unless their boxes on the leading axes are too far apart. In a tile pair, products accumulate over the leading axes; a row
whose partial product plus the product of the suffix norms stays below the threshold with every other row
is left out of the rest. Pairs close to the threshold are decided by the plain cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.blocks import forest, forest_between
from chronoweft.llm.common import materialise, release
from chronoweft.llm.components import connected_components

TILE = 1024
#: Axes of the boxes of tiles.
BOX = 8
#: Numbers of components that fewer vectors share are compared on the axes as given.
LEAST_FOR_AXES = 4096
#: Leading axes after which the bound is taken again.
STEPS = (8, 16, 32)


def _good(vector: str) -> F.Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Axes [width, width] of vectors of that many components, the largest first; partial second moments are summed by Spark."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            x = unit(b["vector"])
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "m": list(total)})

    parts = rows.mapInPandas(moments, "i int, m array<double>")
    sums = parts.groupBy("i").agg(F.array(*(F.sum(F.col("m")[k]) for k in range(width))).alias("m")).orderBy("i").collect()
    return np.linalg.eigh(np.array([r["m"] for r in sums]))[1][:, ::-1].copy()


def linked_pairs(a: np.ndarray, b: np.ndarray, plain_a: np.ndarray, plain_b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose cosine reaches the threshold, leading axes first."""
    out, width, near = np.zeros((len(a), len(b)), bool), a.shape[1], threshold - 1e-9
    rows, cols, at = np.arange(len(a)), np.arange(len(b)), 0
    dots = np.zeros((len(a), len(b)))
    suffix = [np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], 1)[:, ::-1])) for x in (a, b)]
    for stop in [*(s for s in STEPS if s < width), width]:
        dots += a[rows, at:stop] @ b[cols, at:stop].T
        bound = dots if stop == width else dots + suffix[0][rows, stop][:, None] * suffix[1][cols, stop]
        live = bound >= near
        i, j = live.any(1), live.any(0)
        rows, cols, dots, at = rows[i], cols[j], dots[np.ix_(i, j)], stop
        if not len(rows):
            return out
    i, j = np.nonzero(dots >= near)
    exact = dots[i, j] >= threshold + 1e-9
    close = np.flatnonzero(~exact)
    exact[close] = (plain_a[rows[i[close]]] * plain_b[cols[j[close]]]).sum(1) >= threshold
    out[rows[i[exact]], cols[j[exact]]] = True
    return out


def compare_tiles(g: pd.DataFrame, axes: np.ndarray | None, threshold: float) -> pd.DataFrame:
    """Link counts (node, null, links) and forest edges (node, other, null) of one pair of tiles."""
    a = g[g["side"] == 0]
    b = g[g["side"] == 1]
    turn = lambda u: u if axes is None else u @ axes
    ua, ids, copies = unit(a["vector"]), a["node"].to_numpy(), a["copies"].to_numpy()
    if not len(b):
        linked = linked_pairs(turn(ua), turn(ua), ua, ua, threshold)
        np.fill_diagonal(linked, False)
        linked |= linked.T
        edges, counts, others = forest(linked), [(ids, linked @ copies)], ids
    else:
        ub, others = unit(b["vector"]), b["node"].to_numpy()
        linked = linked_pairs(turn(ua), turn(ub), ua, ub, threshold)
        edges, counts = forest_between(linked), [(ids, linked @ b["copies"].to_numpy()), (others, linked.T @ copies)]
    rows = [(int(i), None, int(n)) for x, k in counts for i, n in zip(x, k) if n]
    rows += [(int(ids[i]), int(others[j]), None) for i, j in edges]
    columns = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({name: pd.array(list(x), "Int64") for name, x in zip(("node", "other", "links"), columns)})  # never as floats


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have the same number of components, and their cosine is
    at least ``threshold``. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Equal
    vectors of a label are one node with a number of copies, so a group of copies of any size costs one row; repeated ids count
    as rows, a null id is the least only where all are null. An empty table gives no rows, other columns are not looked at. Scales
    with the square of a label's distinct vectors divided among tile pairs (all that an exact join leaves
    where tiles overlap), never with pairs as rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    good = _good("vector") & F.col("label").isNotNull()
    # a node goes by two numbers of its vector, so that no vector is dealt out as a key
    keys = [F.when(good, x) for x in (F.size("vector"), F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))]
    node = ["label", "size", "key", "key2"]
    rows = materialise(rows.select("vec_id", "label", F.when(good, F.col("vector")).alias("vector"), *(k.alias(c) for k, c in zip(keys, node[1:]))), "rows")
    nodes = rows.where("key is not null").groupBy(*node).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed once written
    sizes = {r["size"]: r["count"] for r in nodes.groupBy("size").count().where(F.col("count") >= LEAST_FOR_AXES).collect()}
    axes = {width: principal_axes(nodes.where(F.col("size") == width).select("vector"), width) for width in sorted(sizes)}

    @F.pandas_udf("array<double>")
    def leading(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), v.index, object)
        for width, part in v.groupby(v.map(len)):
            u = unit(part)
            out[part.index] = [*(u @ axes[width] if width in axes else u)[:, :BOX]]
        return out

    placed = nodes.withColumn("lead", leading("vector"))
    tiles = max(1, -(-nodes.count() // tile))
    # all leading axes and the number of the node: ranges that end on one axis could not part vectors that are equal on it
    dealt = placed.repartitionByRange(tiles, "label", "size", "lead", "node").withColumn("tile", F.spark_partition_id())
    dealt = materialise(dealt, "tiles")
    box = [f(F.coalesce(F.get("lead", F.lit(k)), F.lit(0.0))).alias(f"{n}{k}") for k in range(BOX) for n, f in (("low", F.min), ("high", F.max))]
    span = materialise(dealt.groupBy("label", "size", "tile").agg(*box), "boxes")
    reach = 2 - 2 * threshold + 1e-6  # square of the distance of unit vectors whose cosine reaches the threshold
    a, b = span.alias("a"), span.alias("b")
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"b.low{k}") - F.col(f"a.high{k}"), F.col(f"a.low{k}") - F.col(f"b.high{k}"))
    apart = sum((gap(k) * gap(k) for k in range(BOX)), F.lit(0.0))
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.tile") <= F.col("b.tile")) & (apart <= reach))
    pairs = materialise(pairs.select("a.label", "a.size", F.col("a.tile").alias("left"), F.col("b.tile").alias("right")), "tile-pairs")
    one = pairs.select("label", "size", F.col("left").alias("tile"), "left", "right", F.lit(0).alias("side"))
    two = pairs.where("left <> right").select("label", "size", F.col("right").alias("tile"), "left", "right", F.lit(1).alias("side"))
    sides = dealt.select("label", "size", "tile", "node", "copies", "vector").join(one.union(two), ["label", "size", "tile"])
    found = sides.groupBy("label", "size", "left", "right").applyInPandas(lambda g: compare_tiles(g, axes.get(int(g["size"].iloc[0])), threshold), "node long, other long, links long")
    found = materialise(found, "links")
    release(dealt, span, pairs)
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select("node", "other"))
    with_least = materialise(parts.join(nodes.select("node", "least_id"), "node"), "parts")
    named = materialise(with_least.groupBy("component_id").agg(F.min("least_id").alias("component_least")), "named")
    parts = with_least.drop("least_id").join(named, "component_id").select("node", "component_least")
    by_node = materialise(nodes.drop("vector").join(links, "node", "left").join(parts, "node", "left"), "by-node")
    release(nodes, found, with_least, named)
    out = rows.drop("vector").join(by_node, node, "left")
    component = F.coalesce("component_least", "least_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
