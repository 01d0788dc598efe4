"""Collaborative, location and walk scorers over the directed log; all histories are strictly before t."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions.text import held
from chronoweft.operators.asof import asof_aggregate, asof_attach, attach
from chronoweft.operators.sampling import numbered, recent_lists
from chronoweft.operators.scorers import KEY, LISTED, both, shared_contacts, short
from chronoweft.sources.written import written

#: Users of a source's items that are held as one set of hashes.
REACH = 1 << 16
#: Queries of a source that meet its set of hashes at once.
TOGETHER = 64


def item_cf(events: DataFrame, q: DataFrame, name: str = "item_cf") -> DataFrame:
    """Sum over the source's earlier events of shared users of their item and the target over the root of the
    product of both items' event degrees.

    A query asks only for those users of its target that are among the users of any item of the source, as hashes of 16 bits; what such a user shares with the source are
    the items that count. Users of a target that the source meets at t or later are looked for among those of two items at least, as its own are no other's. Sources whose items have more than ``REACH`` users or one of more than ``LISTED`` ask for all users of the target; targets of more than ``LISTED`` users are joined by rows.
    """
    fc = written(events.groupBy("u", "i").agg(F.min("ts").alias("first")), "first-contacts")
    sizes = written(fc.groupBy("i").agg(F.count("*").alias("n")), "sizes")
    crowded = sizes.where(F.col("n") > LISTED).select("i", F.lit(True).alias("_crowded"))
    wide = fc.join(sizes, "i").groupBy("u").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where((F.col("n") > REACH) | (F.col("most") > LISTED)).select("u", F.lit(True).alias("_wide"))
    crowded, wide = written(crowded, "crowded-items"), written(wide, "wide-sources")
    asked = q.select("src", "tgt", "t").distinct().join(crowded.withColumnRenamed("i", "tgt"), "tgt", "left").join(wide.withColumnRenamed("u", "src"), "src", "left")
    asked = written(asked, "asked")
    lists = fc.join(crowded, "i", "left_anti").groupBy("i").agg(F.collect_list(short(F.col("u"))).alias("users"))
    lists = written(lists, "users-of-items")
    reach = fc.select("u", "i").join(wide, "u", "left_anti").join(lists, "i")
    reach = reach.groupBy(F.col("u").alias("src")).agg(F.sort_array(F.flatten(F.collect_list("users"))).alias("reach"))
    again = held(F.col("reach"), lambda a: F.array_distinct(F.filter(a, lambda x, n: (n > 0) & (x == F.get(a, F.greatest(n - 1, F.lit(0)))))))
    reach = reach.select("src", F.array_distinct("reach").alias("reach"), again.alias("again"))
    few = asked.where("_crowded is null and _wide is null").join(fc.select(F.col("u").alias("src"), F.col("i").alias("tgt"), F.col("first").alias("_first")), ["src", "tgt"], "left")
    few = few.join(lists.withColumnRenamed("i", "tgt"), "tgt").select("src", "tgt", "t", F.coalesce(F.col("_first") >= F.col("t"), F.lit(False)).alias("_new"), "users").repartition("src")
    # what a source reaches meets about ``TOGETHER`` of its targets' users at once, and each target what is left of that
    part = F.pmod(F.xxhash64("tgt", "t"), F.ceil(F.count("*").over(Window.partitionBy("src")) / TOGETHER))
    few = few.withColumn("_part", part).groupBy("src", "_part").agg(F.collect_list(F.struct("tgt", "t", "_new", "users")).alias("_asks")).join(reach, "src")
    users = lambda new: F.flatten(F.transform(F.filter("_asks", lambda a: a["_new"] == new), lambda a: a["users"]))
    few = few.select("src", "_asks", both(F.col("reach"), users(False)).alias("reach"), both(F.col("again"), users(True)).alias("again"))
    few = few.select("src", F.explode("_asks").alias("_ask"), "reach", "again")
    few = few.select("src", "_ask.tgt", "_ask.t", F.explode_outer(both(F.when(F.col("_ask._new"), F.col("again")).otherwise(F.col("reach")), F.col("_ask.users"))).alias("_short"))
    users = fc.select(F.col("i").alias("tgt"), "u", "first")
    few = few.join(users.withColumn("_short", short(F.col("u"))), ["tgt", "_short"])
    every = asked.where("_crowded is null and _wide").join(users, "tgt")
    met = [rows.where("first < t").select("src", "tgt", "t", "u") for rows in (few, every)]
    met = written(met[0].unionByName(met[1]), "users-met")
    common = _shared_items(fc, met.select("src", "u", "t").distinct())
    # what holds for a source's item and for a target is found for rows that do not repeat them for each user
    common = asof_attach(events.select("u", "i", "ts"), common, {"src": "u", "j": "i"}, {"n": ("count", F.col("ts"))})
    common = asof_attach(events.select("i", "ts"), common, {"j": "i"}, {"d_j": ("count", F.col("ts"))})
    terms = met.join(written(common, "shared-items"), ["src", "u", "t"]).select("src", "tgt", "t", "j", "n", "d_j").repartition("src", "tgt", "t")
    terms = terms.groupBy("src", "tgt", "t", "j").agg(F.count("*").alias("co"), F.first("n").alias("n"), F.first("d_j").alias("d_j"))
    if not crowded.isEmpty():
        rows = asof_attach(events.select("u", "i", "ts"), _by_rows(fc, asked.where("_crowded")), {"src": "u", "j": "i"}, {"n": ("count", F.col("ts"))})
        rows = asof_attach(events.select("i", "ts"), written(rows, "terms-by-rows"), {"j": "i"}, {"d_j": ("count", F.col("ts"))})
        terms = terms.unionByName(rows.select(*terms.columns)).repartition("src", "tgt", "t")
    # each degree of the target goes with its part of the sum, as a term has the root of a product
    parts = terms.groupBy("src", "tgt", "t", "d_j").agg(F.sum(F.col("n") * F.col("co")).alias("part")).groupBy("src", "tgt", "t").agg(F.collect_list(F.struct("part", "d_j")).alias("parts"))
    parts = asof_attach(events.select("i", "ts"), written(parts, "parts"), {"tgt": "i"}, {"d_tgt": ("count", F.col("ts"))})
    score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"] / F.sqrt(F.col("d_tgt").cast("double") * x["d_j"]))
    score = parts.select("src", "tgt", "t", score.alias(name))
    return q.join(score, ["src", "tgt", "t"], "left").select(*KEY, F.coalesce(name, F.lit(0.0)).alias(name))


def _shared_items(fc: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, u, t) with each item ``j`` that both have met before t: lists of hashes meet, and what both hold is looked up among the first contacts of both. Pairs with a user of more
    than ``LISTED`` items are joined by rows."""
    many = written(fc.groupBy("u").count().where(F.col("count") > LISTED).select("u"), "crowded-users")
    lists = fc.join(many, "u", "left_anti").groupBy("u").agg(F.collect_list(short(F.col("i"))).alias("items"))
    found = pairs.join(lists, "u").join(lists.withColumnsRenamed({"u": "src", "items": "own"}), "src")
    found = found.select("src", "u", "t", F.explode_outer(both(F.col("own"), F.col("items"))).alias("_short"))
    found = found.join(fc.select("u", F.col("i").alias("j"), "first", short(F.col("i")).alias("_short")), ["u", "_short"]).where("first < t").select("src", "u", "t", "j")
    own = fc.select(F.col("u").alias("src"), F.col("i").alias("j"), "first")
    found = found.join(own, ["src", "j"]).where("first < t").select("src", "u", "t", "j")
    if many.isEmpty():
        return written(found, "common")
    marked = pairs.join(many.select("u", F.lit(True).alias("_u")), "u", "left").join(many.select(F.col("u").alias("src"), F.lit(True).alias("_src")), "src", "left").where("_u or _src")
    # users and items have ids of their own among contacts
    sides = fc.select((F.col("u").cast("long") * 2).alias("u"), (F.col("i").cast("long") * 2 + 1).alias("i"), F.col("first").alias("ts"), F.lit(0).alias("r"), F.lit(0).alias("eid"))
    by_rows = shared_contacts(sides, marked.select((F.col("src").cast("long") * 2).alias("src"), (F.col("u").cast("long") * 2).alias("tgt"), "t"))
    by_rows = by_rows.select(F.shiftright("src", 1).alias("src"), F.shiftright("tgt", 1).alias("u"), "t", F.shiftright("nbr", 1).alias("j"))
    return written(found.unionByName(by_rows), "common")


def _by_rows(fc: DataFrame, asked: DataFrame) -> DataFrame:
    """src, tgt, t, j, co for targets of many users: a user shares two items from the later of both first contacts on, so one as-of count over these times serves all queries of an item pair."""
    terms = written(asked.select("src", "tgt", "t").join(fc.select(F.col("u").alias("src"), F.col("i").alias("j"), "first"), "src").where("first < t").drop("first"), "pairs-by-rows")
    shared = terms.select("tgt", "j").distinct().join(fc.select(F.col("i").alias("j"), "u", F.col("first").alias("b")), "j").join(fc.select(F.col("i").alias("tgt"), "u", F.col("first").alias("a")), ["tgt", "u"])
    shared = shared.select("tgt", "j", F.greatest("a", "b").alias("ts"))
    co = asof_aggregate(shared, terms.select("tgt", "j", "t"), ["tgt", "j"], {"co": ("count", F.col("ts"))})
    return attach(terms, co, {"tgt": "tgt", "j": "j"}).where("co > 0").select("src", "tgt", "t", "j", "co")


def user_cf(events: DataFrame, q: DataFrame) -> DataFrame:
    """The same with users and items exchanged: over the target's earlier events, by shared items of the users."""
    swapped = q.select(*KEY, F.col("tgt").alias("src"), F.col("src").alias("tgt"), "t")
    return item_cf(events.select(F.col("i").alias("u"), F.col("u").alias("i"), "ts"), swapped, "user_cf")


def location_share(events: DataFrame, q: DataFrame, locations: DataFrame) -> DataFrame:
    """Share of the source's located earlier items (node, loc) that lie where the target does; 0 without any."""
    located = events.join(locations.withColumnRenamed("node", "i"), "i").select("u", "loc", "ts")
    asked = q.join(locations.withColumnRenamed("node", "tgt"), "tgt")
    same = asof_aggregate(located, asked.select(F.col("src").alias("u"), "loc", "t"), ["u", "loc"], {"same": ("count", F.col("ts"))})
    everything = asof_aggregate(located.select("u", "ts"), asked.select(F.col("src").alias("u"), "t"), ["u"], {"everything": ("count", F.col("ts"))})
    scored = attach(attach(asked, same, {"src": "u", "loc": "loc"}), everything, {"src": "u"})
    share = scored.where("everything > 0").select("src", "tgt", "t", (F.col("same") / F.col("everything")).alias("location_share")).distinct()
    return q.join(share, ["src", "tgt", "t"], "left").select(*KEY, F.coalesce("location_share", F.lit(0.0)).alias("location_share"))


def sampled_pagerank(events: DataFrame, q: DataFrame, fanout: int = 20, depth: int = 3, alpha: float = 0.15) -> DataFrame:
    """Sum over hops h from 1 of alpha (1 - alpha)^h times the share of the fanout^h recent walks that end in the
    target; missing neighbours end a walk. Steps are held as lists, and the last ones are made only from nodes that meet a target of the source."""
    keys = ["src", "t"]
    seq, q = written(numbered(events), "numbered"), written(q, "asked")
    wanted = written(q.groupBy(*keys).agg(F.collect_set("tgt").alias("_tgts")), "wanted")
    frontier = wanted.select(*keys, F.col("src").alias("node"), F.col("t").alias("at"))
    lists, hits = None, []
    for hop in range(1, depth + 1):
        if hop > 1:
            steps = lists if hop < depth else _leading(lists, seq, wanted)
            frontier = steps.select(*keys, F.explode("_e").alias("_e")).select(*keys, F.col("_e.nbr").alias("node"), F.col("_e.ts").alias("at"))
            frontier = written(frontier, "steps") if hop == depth else frontier  # counted first, then used
        lists = written(recent_lists(seq, frontier, fanout, ["nbr", "ts"] if hop < depth else ["nbr"], "_e").select(*keys, F.transform("_e", lambda e: e.dropFields("seq")).alias("_e")), "walks")
        ends = lists.select(*keys, F.transform("_e", lambda e: e["nbr"]).alias("_ends")).join(wanted, keys).select(*keys, "_tgts", F.explode("_ends").alias("tgt"))
        counts = written(ends.where(F.array_contains("_tgts", F.col("tgt"))).groupBy(*keys, "tgt").agg(F.count("*").alias("m")), "hits")
        hits.append(counts.select(*keys, "tgt", (F.col("m") * (alpha * (1 - alpha) ** hop / fanout**hop)).alias("mass")))
    mass = reduce(DataFrame.unionByName, hits).groupBy(*keys, "tgt").agg(F.sum("mass").alias("ppr"))
    return q.join(mass, ["src", "tgt", "t"], "left").select(*KEY, F.coalesce("ppr", F.lit(0.0)).alias("ppr"))


def _leading(lists: DataFrame, seq: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lists`` (src, t, _e: nbr and ts) joined up by (src, t), without the steps to nodes that meet none of ``wanted``'s (src, t, _tgts): only these can come before the last step. Meetings are hashes of
    contacts, so a few others stay; targets of more than ``LISTED`` events leave all."""
    keys = ["src", "t"]
    crowded = seq.groupBy("node").count().where(F.col("count") > LISTED).select(F.col("node").alias("tgt"), F.lit(True).alias("_many"))
    contacts = seq.join(F.broadcast(crowded), seq["node"] == F.col("tgt"), "left_anti").groupBy(F.col("node").alias("tgt")).agg(F.collect_set(short(F.col("nbr"))).alias("_met"))
    asked = wanted.select(*keys, F.explode("_tgts").alias("tgt")).join(crowded, "tgt", "left").join(contacts, "tgt", "left")
    before = asked.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("_met"))).alias("_met"), F.max("_many").alias("_many"))
    # numbers move in two lists, which take half the room of one of rows
    part = lambda name: F.transform("_e", lambda e: e[name]).alias(name)
    steps = lists.select(*keys, part("nbr"), part("ts")).groupBy(*keys).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("nbr", "ts"))).join(before, keys)
    steps = steps.select(*keys, "_many", "_met", F.arrays_zip("nbr", "ts").alias("_e"))
    # held: the planner would put the array into the function, which would work it out for each step
    met = held(both(F.col("_met"), F.transform("_e", lambda e: short(e["nbr"]))), lambda near: F.filter("_e", lambda e: F.array_contains(near, short(e["nbr"]).cast("int"))))
    return steps.select(*keys, F.when(F.col("_many"), F.col("_e")).otherwise(met).alias("_e"))


def pair_stats(events: DataFrame, q: DataFrame) -> DataFrame:
    """Directed number of earlier events of the pair, and its last earlier time in either direction (null: none)."""
    return add_pair_stats(events, q, q).select(*KEY, "directed", "last_ts")


def add_pair_stats(events: DataFrame, q: DataFrame, onto: DataFrame) -> DataFrame:
    """``onto``, the rows of ``q`` with any further columns, with those of ``pair_stats``."""
    ends = lambda a, b: [F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")]
    out = asof_attach(events.select("u", "i", "ts"), onto, {"src": "u", "tgt": "i"}, {"directed": ("count", F.col("ts"))}, counted=q)
    told, named = events.select(*ends("u", "i"), "ts"), {"_lo": "_lo", "_hi": "_hi"}
    return asof_attach(told, out.select("*", *ends("src", "tgt")), named, {"last_ts": ("max", F.col("ts"))}, counted=q.select(*ends("src", "tgt"))).drop(*named)
