"""Exact top-k search by inner product with M-trees.

A ball of radius r around p bounds the inner product of q with all in it by q.p + |q| r (Cauchy-Schwarz), so a metric tree serves
inner products as it serves distances. Candidates go to the group of the nearest pivot, large groups to several trees. A tree is a set of
pages: an inner page holds routing objects with covering radius, distance to the parent's routing object and child page; a leaf
holds entries with their distance to the page's routing object. A query goes best first: pages by their largest possible
product, and an object is compared only where its stored distance to the parent does not rule it out by the triangle
inequality; the queries of a block go through a tree together. A query asks a tree of its own group first; its k-th score there is the floor for all other groups, and those whose
ball stays below it are not asked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise

#: Candidates of a tree, entries of a leaf, children of an inner page, queries of a block, about; pivots at most, and rows they are chosen from.
TREE, LEAF, FANOUT, BLOCK, PIVOTS, SAMPLE = 8192, 128, 32, 1024, 512, 8192
#: Results of a search that wait to be cut to each query's k best.
HELD = 1 << 19
#: Bounds get this much room for rounding, so rounding never loses a candidate.
ROOM = 1e-3
PAGES = "size int, tree long, page int, leaf boolean, ids binary, copies binary, first binary, points binary, to_parent binary, radius binary, children array<int>"


def floor_scaled(column: str, scale: int) -> Column:
    return F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def build_pages(ids: list, copies: list, x: np.ndarray, rng: np.random.Generator) -> list[dict]:
    """Pages of one tree over the distinct points ``x``, each with the ids (and their copies) that stand there; page 0 is the root."""
    pages: list[dict] = []

    def add(rows: np.ndarray, pivot: np.ndarray | None) -> int:
        at = len(pages)
        pages.append({})
        to = lambda p: np.zeros(len(p)) if pivot is None else lengths(p - pivot)
        if len(rows) <= LEAF:
            held = [np.asarray(ids[i], np.int64) for i in rows]
            pages[at] = {
                "page": at, "leaf": True, "ids": np.concatenate(held).tobytes(), "copies": np.concatenate([np.asarray(copies[i], np.int64) for i in rows]).tobytes(),
                "first": np.cumsum([0, *map(len, held)]).tobytes(), "points": x[rows].tobytes(), "to_parent": to(x[rows]).tobytes(), "radius": b"", "children": [],
            }
            return at
        routing = x[rng.choice(rows, min(FANOUT, -(-len(rows) // (LEAF // 2))), replace=False)]
        nearest = ((routing**2).sum(1) - 2 * x[rows] @ routing.T).argmin(1)
        kept, radius, children = [], [], []
        for k in np.unique(nearest):
            part = rows[nearest == k]
            if len(part) == len(rows):  # no split: rows that lie alike are dealt out as they come
                half = len(rows) // 2
                parts = [rows[:half], rows[half:]]
            else:
                parts = [part]
            for part in parts:
                kept.append(k)
                radius.append(lengths(x[part] - routing[k]).max())
                children.append(add(part, routing[k]))
        routing = routing[kept]
        pages[at] = {"page": at, "leaf": False, "ids": b"", "copies": b"", "first": b"", "points": routing.tobytes(), "to_parent": to(routing).tobytes(), "radius": np.array(radius).tobytes(), "children": children}
        return at

    add(np.arange(len(x)), None)
    return pages


class Tree:
    """A tree read back from its pages; ``compared`` counts the objects whose product was taken."""

    def __init__(self, pages: pd.DataFrame, width: int):
        self.compared = 0
        self.pages = {}
        for p in pages.itertuples():
            longs = (np.frombuffer(x, np.int64) for x in (p.ids, p.copies, p.first))
            self.pages[p.page] = (p.leaf, *longs, np.frombuffer(p.points).reshape(len(p.to_parent) // 8, width), np.frombuffer(p.to_parent), np.frombuffer(p.radius), p.children)

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, -id) of at least ``floor``, a row each; the id ``own`` is left out. Points and ``q`` are whole numbers."""
        _, ids, scores = self.search_all(np.asarray(q)[None, :], np.array([own]), k, np.array([floor]))
        return list(zip(scores.tolist(), (-ids).tolist()))

    def search_all(self, q: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for all rows of ``q`` at once: number of the row, id, score. A page is visited once, by the queries that its bound does not rule out; their products with its objects
        are one product of matrices."""
        floors, size, best = floors.astype(np.float64), lengths(q), np.full((len(q), k), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        todo: list[tuple] = [(-np.inf, 0, np.arange(len(q)), np.full(len(q), np.inf), np.zeros(len(q)), True)]
        while todo:
            _, page, rows, most, at_parent, root = heapq.heappop(todo)
            kept = most >= floors[rows] - ROOM
            rows, most, at_parent = rows[kept], most[kept], at_parent[kept]
            leaf, ids, copies, first, points, to_parent, radius, children = self.pages[page]
            if not len(rows) or not len(points):
                continue
            use = np.arange(len(points))
            if not root:
                # the product with the parent alone rules objects out before their own is taken
                use = np.flatnonzero((at_parent + np.outer(to_parent + (0 if leaf else radius), size[rows]) >= floors[rows] - ROOM).any(1))
                if not len(use):
                    continue
            self.compared += len(use) * len(rows)
            score = points[use] @ q[rows].T
            if not leaf:
                bound = np.minimum(score + np.outer(radius[use], size[rows]), most)
                for i, s, b in zip(use.tolist(), score, bound):
                    at = np.flatnonzero(b >= floors[rows] - ROOM)
                    if len(at):
                        heapq.heappush(todo, (-b[at].max(), children[i], rows[at], b[at], s[at], False))
                continue
            # floors rise by points, each counted once, and not where the query's own id stands alone
            each = first[use + 1] - first[use]
            alone = (each == 1)[:, None] & (ids[first[use]][:, None] == own[rows])
            best[rows] = -np.partition(-np.hstack([best[rows], np.where(alone, -np.inf, score).T]), k - 1, axis=1)[:, :k]
            floors[rows] = np.maximum(floors[rows], best[rows].min(1))
            point, row = np.nonzero((score >= floors[rows]) & ~alone)
            n = each[point]
            at = np.repeat(first[use[point]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, value = np.repeat(rows[row], n), np.repeat(score[point, row], n)
            other = ids[at] != own[row]
            held.append((row[other], ids[at][other], value[other].astype(np.int64), copies[at][other]))
            waiting += len(row)
            if waiting > HELD:
                held = [self._first(held, k)]
                waiting = len(held[0][0])
        row, ids, value, copies = self._first(held, k)
        # rows that repeat an id count each
        n = np.minimum(copies, k)
        row, ids, value = (np.repeat(x, n) for x in (row, ids, value))
        start = np.searchsorted(row, row)
        top = np.arange(len(row)) - start < k
        return row[top], ids[top], value[top]

    @staticmethod
    def _first(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
        """Of (row, id, score, copies) each row's k first by score, then smaller id, in that order."""
        row, ids, value, copies = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(4))
        order = np.lexsort((ids, -value, row))
        row, ids, value, copies = (x[order] for x in (row, ids, value, copies))
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[top], ids[top], value[top], copies[top]


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, tree_size: int = TREE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query (rows whose vec_id is divisible by
    ``query_every``) the k largest inner products of floor(scale * x) with all rows of another id, ties to the
    smaller id. Fewer rows give fewer results, an empty table none.

    Vectors that are null or hold null or non-finite components take no part, as query or candidate. Vectors of different numbers of
    components have no product: a query is answered from those of its own number. Rows that repeat an id are candidates
    each, and the queries of one id are answered once (by its largest vector, a longer one being larger). A null id takes no
    part; other columns are not looked at. Of equal vectors the k + 1 smallest ids can be among anyone's k best, so a group of copies of any
    size is one object with so many ids. Trees are bounded in size and each (tree, block of queries) is a task of its own: memory per
    task does not grow with the table.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where("vec_id is not null and vector is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.where(~F.exists("vector", bad)).select("vec_id", floor_scaled("vector", scale).cast("array<double>").alias("v"))
    key = ["size", "key", "key2"]
    rows = materialise(rows.select("vec_id", "v", F.size("v").alias("size"), F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("key2")), "whole")
    ids = rows.groupBy(*key, "vec_id").agg(F.count("*").alias("copies"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    ids = ids.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy(*key).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("copies").alias("copies"))
    points = materialise(rows.groupBy(*key).agg(F.first("v").alias("v")).join(ids, key), "points")
    total = points.count()
    empty = "query_id long, rank int, vec_id long, score long"
    if not total:
        return vectors.sparkSession.createDataFrame([], empty)

    # pivots by number of components: rows of the least hashes
    each = {r["size"]: r["count"] for r in points.groupBy("size").count().where(F.col("count") > tree_size).collect()}
    pivots = {}
    for size, count in each.items():
        some = points.where(F.col("size") == size).orderBy("key", "key2").limit(min(PIVOTS, -(-count // tree_size), SAMPLE)).collect()
        pivots[size] = np.array([r["v"] for r in some])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            group, far = np.zeros(len(b), np.int64), np.zeros(len(b))
            for size, at in b.reset_index(drop=True).groupby("size").groups.items():
                if size in pivots:
                    p, x = pivots[size], np.array(b["v"].iloc[at].tolist())
                    group[at] = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
                    far[at] = lengths(x - p[group[at]])
            yield b.assign(group=group, far=far)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in points.schema]
    grouped = materialise(points.mapInPandas(nearest, ", ".join([*fields, "group long", "far double"])), "grouped")
    spans = {(r["size"], r["group"]): (r["n"], r["radius"]) for r in grouped.where(F.col("size").isin(*each) if each else F.lit(False)).groupBy("size", "group").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    spark = vectors.sparkSession
    parts = spark.createDataFrame([(s, g, -(-n // tree_size)) for (s, g), (n, _) in spans.items()], "size int, group long, parts long")
    in_parts = lambda df: df.join(F.broadcast(parts), ["size", "group"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tree_id = F.col("group") * (1 << 32) + F.pmod(F.xxhash64(F.lit(2), "key"), F.col("parts"))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        size, tree = int(g["size"].iloc[0]), int(g["tree"].iloc[0])
        x = np.array(g["v"].tolist(), np.float64).reshape(len(g), size)
        pages = build_pages(g["ids"].tolist(), g["copies"].tolist(), x, np.random.default_rng(tree))
        return pd.DataFrame(pages).assign(size=size, tree=tree)[[f.split()[0] for f in PAGES.split(", ")]]

    trees = in_parts(grouped).withColumn("tree", tree_id)
    pages = materialise(trees.groupBy("size", "tree").applyInPandas(build, PAGES), "pages")
    largest = F.max(F.struct("size", "v", "key", "key2")).alias("q")
    asking = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(largest).select("vec_id", "q.*")
    asking = asking.join(grouped.select(*key, "group"), key).withColumn("floor", F.lit(float("-inf")))
    blocks = max(1, -(-rows.count() // query_every // BLOCK))
    asking = materialise(asking.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")), "queries")

    def answer(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width, own = int(p["size"].iloc[0]), q["vec_id"].to_numpy()
        x = np.array(q["v"].tolist(), np.float64).reshape(len(q), width)
        row, ids, scores = Tree(p, width).search_all(x, own, k, q["floor"].to_numpy())
        return pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": scores})

    def ask(asked: DataFrame) -> DataFrame:
        """The stated queries against all rows, in blocks: ``asked`` has a row for each query and tree."""
        of = ["size", "tree", "block"]
        met = pages.join(asked.select(*(F.col(c).alias(c) for c in of)).distinct(), ["size", "tree"])
        return asked.groupBy(*of).cogroup(met.groupBy(*of)).applyInPandas(answer, "query_id long, vec_id long, score long")

    home = materialise(ask(in_parts(asking).withColumn("tree", tree_id)), "home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "worst")

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query by the trees it has not asked and whose ball can reach its floor."""
        for b in batches:
            out = []
            for row in b.itertuples():
                size = int(row.size)
                if size not in pivots:
                    continue  # one tree holds all of them
                p, q = pivots[size], np.asarray(row.v)
                bound = p @ q + lengths(q) * np.array([spans.get((size, g), (0, -np.inf))[1] for g in range(len(p))])
                for g in np.flatnonzero(bound >= row.floor - ROOM).tolist():
                    out += [(size, row.vec_id, row.v, row.floor, row.block, t) for t in range(g << 32, (g << 32) + -(-spans[size, g][0] // tree_size)) if t != row.tree]
            yield pd.DataFrame(out, columns=["size", "vec_id", "v", "floor", "block", "tree"])

    floored = in_parts(asking).withColumn("tree", tree_id).drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("worst", F.lit(float("-inf"))))
    rest = materialise(floored.select("size", "vec_id", "v", "floor", "block", "tree").mapInPandas(others, "size int, vec_id long, v array<double>, floor double, block int, tree long"), "others")
    found = home.union(ask(rest))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
