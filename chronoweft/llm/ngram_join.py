"""N-gram Jaccard join by MinHash banding.

1. Every text becomes the set of its word n-grams (64-bit hashes); equal sets are one class.
2. MinHash bands of each class are shuffled on the band hash; classes that share a bucket are candidates. Classes are
   tied to the least class of each of their buckets, and ties are closed to clusters, so that the full sets of a small
   cluster move once, not once a band.
3. Pairs are verified on the full sets. A small cluster is verified whole. A large one is verified in pairs of blocks: of the
   whole cluster where its buckets hold most of it (a group of near copies), else bucket by bucket, each pair in the
   first band it shares (loose texts that only a chain of buckets ties). A task returns link counts and a
   spanning forest, so the number of rows never grows with the square of a cluster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.blocks import forest, forest_between
from chronoweft.llm.common import CACHE_ENTRIES, materialise, release, worker_cache
from chronoweft.llm.components import connected_components
from chronoweft.llm.words import WordTable

WORD = re.compile(r"[^\W_]+")
#: Classes in a block, and rows that a group of small clusters holds about.
BLOCK = 512
#: Ids up to this number (with their keys 40 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def choose_bands(threshold: float, recall: float, max_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most selective layout whose chance to meet a pair at the threshold is at least ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = ceil(log(1 - recall) / log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            best = bands, rows
    assert best, "no layout has this recall within max_hashes"
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).reshape(-1, 1)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of word hashes; fewer than n words are one gram, none give none."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h + words[i : i + len(h)])
    return np.unique(h)


def text_shingles(texts: list[str], n: int) -> list[np.ndarray]:
    table = worker_cache("word hashes", lambda: WordTable(_hash_words, CACHE_ENTRIES))
    split = [WORD.findall(t.lower()) for t in texts]
    rows, hashes = table.find([w for x in split for w in x])
    ends = np.cumsum([len(x) for x in split])
    return [shingles(hashes[rows[e - len(x) : e], 0], n) for e, x in zip(ends, split)]


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash of each band of the MinHash signature of a set."""
    rng = np.random.default_rng(1)
    a = (rng.integers(0, 1 << 63, bands * rows, np.uint64) << np.uint64(1)) | np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        x = s[i : i + 1024, None] * a
        np.minimum(low, (x ^ (x >> np.uint64(32))).min(0), out=low)
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        h = _mix(h + low[i::rows])
    return h


def text_key() -> F.Column:
    return F.xxhash64("text")


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (of the text as it is), set_key (null without words), bands: one row per document."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                sets = text_shingles(b["text"].fillna("").tolist(), n)
                yield pd.DataFrame({
                    "doc_id": b["doc_id"], "text_key": b["text_key"], "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [band_hashes(s, bands, rows).view(np.int64) if len(s) else None for s in sets],
                })

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInPandas(run, "doc_id long, text_key long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """set_key and packed set of the rows of ``docs`` (text, set_key) whose text has the set of that key."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                grams = [s.tobytes() for s in text_shingles(b["text"].fillna("").tolist(), n)]
                same = [xxhash.xxh3_128_digest(s) == k for s, k in zip(grams, b["set_key"])]
                yield b[["set_key"]].assign(grams=grams)[same]

    return docs.select("text", "set_key").mapInPandas(run, "set_key binary, grams binary")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``, as a matrix product over the
    grams that both sides have, a slice of grams at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    for i in range(0, len(both), 8192):
        part, sides = both[i : i + 8192], []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for row, s in zip(m, sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                row[at[part[at] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def first_shared(a: pd.DataFrame, b: pd.DataFrame, band: int) -> np.ndarray:
    """Which pairs share this band and none before it."""
    x, y = (np.array(s["bands"].tolist(), np.int64)[:, : band + 1] for s in (a, b))
    out = x[:, None, band] == y[None, :, band]
    for k in range(band):
        out &= x[:, None, k] != y[None, :, k]
    return out


def verify_block(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts (rep, null, links) and forest edges (rep, other, null) of the clusters in one group. With a ``band`` of 0 or
    more the group is a bucket's, and only pairs that share no band before it are its own."""
    rows: list[tuple[int, int | None, int | None]] = []
    for _, c in g.drop_duplicates("rep").groupby("cluster", sort=False):
        sides = [c[c["side"] == s] for s in (0, 1)]
        a, b = sides if len(sides[1]) else (sides[0], sides[0])
        if not len(a) or a is b and len(a) < 2:
            continue
        mine = None
        if (band := int(c["band"].iloc[0])) >= 0:
            mine = first_shared(a, b, band)
            if a is b:
                np.fill_diagonal(mine, False)
            keep = [mine.any(1), mine.any(0)]
            if not keep[0].any():
                continue
            if a is not b:
                a, b, mine = a[keep[0]], b[keep[1]], mine[np.ix_(*keep)]
        sets = [[np.frombuffer(x, np.uint64) for x in s["grams"]] for s in (a, b)]
        inter = overlaps(*sets)
        sizes = [np.array([len(s) for s in x], np.float32) for x in sets]
        union = (sizes[0][:, None] + sizes[1] - inter).astype(np.int64)
        linked = inter.astype(np.int64) * 1_000_000 >= round(threshold * 1e6) * union
        if mine is not None:
            linked &= mine
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        if a is b:
            np.fill_diagonal(linked, False)
            edges = forest(linked)
            counts = [(ra, linked @ a["copies"].to_numpy())]
        else:
            edges = forest_between(linked)
            counts = [(ra, linked @ b["copies"].to_numpy()), (rb, linked.T @ a["copies"].to_numpy())]
        rows += [(int(r), None, int(n)) for reps, k in counts for r, n in zip(reps, k) if n]
        rows += [(int(ra[i]), int(rb[j]), None) for i, j in edges]
    columns = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({name: pd.array(list(x), "Int64") for name, x in zip(("rep", "other", "links"), columns)})  # never as floats


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, max_hashes: int = 192, keys: bool = False) -> DataFrame:
    """Links between documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more.

    Returns for every row of ``docs`` (doc_id, text; other columns are not looked at): doc_id, class_id (least id of the
    documents with the same set), n_links (other documents linked with it, copies included), component_id (least id that
    links reach), kept (doc_id is the component's); with ``keys`` also text_key (of the text as it is) and group_key (equal for all
    rows of a component, null where nothing can link). Words are runs of letters and
    digits in lower case; a text of fewer than n words is one gram of them all; null texts and texts without words link with
    nothing, whole texts of any length are compared. Rows that repeat an id count as copies of each other if their sets are
    equal, else as documents of their own. A null id is the least only where all are null. An empty table gives no rows. Found links are
    exact; a pair at the very threshold is met with a chance of ``recall`` (more above it).
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialise(signatures(docs, n, bands, rows), "signatures")
    classes = sig.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # a class goes by its row's number, fixed once written: two sets may have the same least id where ids repeat, and a shorter hash could collide
    classes = materialise(classes.select("set_key", "least_id", "copies", "bands", F.monotonically_increasing_id().alias("rep")), "classes")
    members = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    least = members.groupBy("bucket").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = materialise(least, "buckets")
    tied = materialise(members.join(least, "bucket"), "tied")
    clusters = connected_components(tied.where("rep > least").select("rep", "least")).withColumnsRenamed({"node": "rep", "component_id": "cluster"})
    clusters = materialise(clusters, "clusters")
    found = _verified(docs, clusters, tied, classes, n, threshold)
    release(tied, least, clusters)
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select("rep", "other")).withColumnRenamed("node", "rep")
    # the least id of each component, over its classes
    with_least = materialise(parts.join(classes.select("rep", "least_id"), "rep"), "parts")
    named = materialise(with_least.groupBy("component_id").agg(F.min("least_id").alias("component_least")), "named")
    parts = with_least.drop("least_id").join(named, "component_id").select("rep", "component_least", "component_id")
    by_class = materialise(classes.drop("bands").join(links, "rep", "left").join(parts, "rep", "left"), "by-class")
    release(classes, found, with_least, named)
    out = sig.select("doc_id", "text_key", "set_key").join(by_class, "set_key", "left")
    class_id = F.coalesce("least_id", "doc_id")
    component = F.coalesce("component_least", class_id)
    return out.select(
        "doc_id", class_id.alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        *(["text_key", F.coalesce(F.col("component_id"), "rep").alias("group_key")] if keys else []),
    )


def _verified(docs: DataFrame, clusters: DataFrame, tied: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    sizes = materialise(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    members = materialise(clusters.join(sizes, "cluster").join(classes.select("rep", "least_id", "copies", "set_key", "bands"), "rep"), "cluster-members")
    total = members.count()
    # rows to be sent for a large cluster: a row for each block, of the cluster or of its buckets
    blocks = lambda size: F.ceil(F.col(size) / BLOCK).cast("int")
    large = sizes.where(F.col("size") > BLOCK)
    buckets = tied.where("rep = least").join(clusters, "rep").join(large, "cluster").groupBy("cluster").agg(F.sum(F.col("n") * blocks("n")).alias("by_bucket"), F.first("size").alias("size"))
    apart = materialise(buckets.where(F.col("by_bucket") < F.col("size") * blocks("size")).select("cluster", F.lit(True).alias("apart")), "apart")
    own_buckets = tied.join(members.join(apart, "cluster", "left_semi").select("rep"), "rep", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("band", "bucket", "n")).alias("buckets"))
    # rows that repeat an id with another text are told apart by the key of their set
    ids = members.select(F.col("least_id").alias("doc_id"), "set_key")
    sets = _sets(docs.join(F.broadcast(ids) if total <= BROADCAST_IDS else ids, "doc_id"), n)
    sets = sets.join(members.join(apart, "cluster", "left").join(own_buckets, "rep", "left"), "set_key")
    bins = max(16, 2 * total // BLOCK)
    key = lambda of, band, a, b, side: F.struct(of.alias("of"), band.cast("int").alias("band"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    nothing = F.lit(-1)

    def dealt(of: F.Column, band: F.Column, size: F.Column) -> F.Column:
        """A block meets each block of its group in a group of two."""
        last = F.ceil(size / BLOCK).cast("int") - 1
        own = F.pmod(F.xxhash64("rep"), last + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda o: key(of, band, F.least(own, o), F.greatest(own, o), F.when(own > o, 1).otherwise(0)))

    # small clusters share a group
    small = F.array(key(F.lit(-1).cast("long"), nothing, nothing, F.pmod(F.xxhash64("cluster"), F.lit(bins)), F.lit(0)))
    by_bucket = F.flatten(F.transform("buckets", lambda x: dealt(x["bucket"], x["band"], x["n"])))
    keys = F.when(F.col("size") <= BLOCK, small).when(F.col("apart"), by_bucket).otherwise(dealt(F.col("cluster"), nothing, F.col("size")))
    bands = F.when(F.col("apart"), F.col("bands"))
    found = (
        sets.withColumn("k", F.explode(keys)).select("rep", "copies", "cluster", bands.alias("bands"), "grams", "k.*")
        .groupBy("of", "band", "a", "b").applyInPandas(lambda g: verify_block(g, threshold), "rep long, other long, links long")
    )
    found = materialise(found, "links")
    release(sizes, members, apart)
    return found
