"""Neighbour and negative draws. Draws are rules of ids, so a lost task draws the same again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.asof import asof_aggregate, asof_attach, attach, crowded, with_latest
from chronoweft.operators.prefix import batches, numbers_within, row_numbers
from chronoweft.operators.splits import historical_candidates
from chronoweft.sources.tables import adjacency, draw, target_pool
from chronoweft.sources.written import written


def random_negatives(events: DataFrame, positives: DataFrame, per: int, seed: int = 0, first: int = 1) -> DataFrame:
    """``per`` drawn targets of every positive (eid, src, t) from the distinct targets; hits on it are kept."""
    pool = target_pool(events)
    size = pool.agg(F.count("*").alias("size"))
    slots = positives.select("eid", "src", "t", F.explode(F.sequence(F.lit(first), F.lit(first + per - 1))).alias("k")) if per > 0 else positives.select("eid", "src", "t", F.lit(0).alias("k")).limit(0)
    return slots.join(F.broadcast(size)).withColumn("idx", draw(F.col("eid"), F.col("k"), F.col("size"), seed)).join(pool, "idx").select("eid", "k", "src", F.col("node").alias("tgt"), "t")


def mixed_negatives(events: DataFrame, positives: DataFrame, per: int, share: float, start: float, end: float) -> DataFrame:
    """``per`` negatives of each positive: the first int(per * share) random, the others from the source's earlier
    targets outside the batch [start, end], random again for a source without any; ``kind`` says which."""
    n_random = int(per * share)
    anyway = random_negatives(events, positives, per)
    old = historical_candidates(events, start, end).select(F.col("u").alias("src"), F.col("i").alias("old"))
    old = written(numbers_within(old, ["src"], [F.col("old")], "idx").withColumn("idx", F.col("idx") - 1), "earlier-targets")
    sizes = old.groupBy("src").agg(F.count("*").alias("size"))
    wanted = anyway.join(sizes, "src", "left").withColumn("idx", F.when((F.col("k") > n_random) & (F.col("size") > 0), draw(F.col("eid"), F.col("k"), F.col("size"))))
    picked = wanted.join(old, ["src", "idx"], "left")
    return picked.select("eid", "k", "src", F.coalesce("old", "tgt").alias("tgt"), "t", F.when(F.col("old").isNotNull(), "historical").otherwise("random").alias("kind"))


def numbered(events: DataFrame) -> DataFrame:
    """Adjacency with ``seq``, the event's number in its node's order (ts, eid, nbr)."""
    return numbers_within(adjacency(events), ["node"], [F.col("ts"), F.col("eid"), F.col("nbr"), F.desc("role")], "seq")


def recent_events(seq: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """The last ``size`` events before t of each distinct (node, t), from ``numbered`` events: node, t, nbr, ts."""
    n = asof_aggregate(seq.select("node", "ts"), asked, ["node"], {"n": ("count", F.col("ts"))}).where("n > 0")
    return with_latest(n, seq, "node", "n", size, ["nbr", "ts"], "_e").select("node", "t", F.explode("_e").alias("_e")).select("node", "t", "_e.nbr", "_e.ts")


def recent_lists(seq: DataFrame, asked: DataFrame, size: int, fields: list[str], name: str) -> DataFrame:
    """The rows of ``asked`` (node, at and others) whose node has events before ``at``, with ``name``, ``fields`` of the last ``size`` of them, oldest first. ``seq``: numbered events."""
    counted = asof_attach(seq.select("node", "ts"), asked, {"node": "node"}, {"_n": ("count", F.col("ts"))}, t="at").where("_n > 0")
    return with_latest(counted, seq, "node", "_n", size, fields, name).drop("_n")


def uniform_neighbors(events: DataFrame, q: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` draws with replacement from the source's events before t: eid, k, slot (from 0), nbr, ts."""
    seq = numbered(events)
    counted = asof_attach(seq.select("node", "ts"), q, {"src": "node"}, {"n": ("count", F.col("ts"))})
    slots = counted.where("n > 0").select("eid", "k", F.col("src").alias("node"), "n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    return slots.withColumn("seq", draw(F.col("eid"), F.col("slot") + F.col("k") * 31, F.col("n"), seed) + 1).join(seq.select("node", "seq", "nbr", "ts"), ["node", "seq"]).select("eid", "k", "slot", "nbr", "ts")


def unique_pairs(events: DataFrame, start: float, end: float) -> DataFrame:
    """Distinct (u, i) with an event in the closed range."""
    return events.where(F.col("ts").between(start, end)).select("u", "i").distinct()


def free_targets(asked: DataFrame, taken: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, eid, k) with ``tgt``: a drawn one of the pool's targets (node, idx) that ``taken`` (keys, tgt) leaves free. The draw is a place among
    the free ones, so it needs no second try: a taken target of number e with j taken ones before it has e - j free ones before it, and those up to the place move it on. Where nothing
    is free, any target is drawn."""
    size = pool.agg(F.count("*").alias("_all"))
    held = written(numbers_within(taken.distinct().join(pool.withColumnRenamed("node", "tgt"), "tgt").select(*keys, "idx"), keys, [F.col("idx")], "_j"), "taken")
    counts = held.groupBy(*keys).agg(F.count("*").alias("_held"))
    slots = asked.join(counts, keys, "left").join(F.broadcast(size)).withColumn("_free", F.col("_all") - F.coalesce("_held", F.lit(0)))
    slots = written(slots.withColumn("_at", draw(F.col("eid"), F.col("k"), F.when(F.col("_free") > 0, F.col("_free")).otherwise(F.col("_all")))), "slots")
    before = held.select(*keys, (F.col("idx") - F.col("_j") + 1).alias("ts"))
    moved = asof_aggregate(before, slots.where("_free > 0").select(*keys, (F.col("_at") + 1).alias("t")), keys, {"_up": ("count", F.col("ts"))}, width=4096)
    out = slots.withColumn("t_", F.col("_at") + 1).join(moved.withColumnRenamed("t", "t_"), [*keys, "t_"], "left")
    return out.withColumn("idx", F.col("_at") + F.coalesce("_up", F.lit(0))).join(pool, "idx").select(*asked.columns, F.col("node").alias("tgt"))


def checked_negatives(events: DataFrame, positives: DataFrame, per: int, batch: DataFrame) -> DataFrame:
    """``per`` drawn targets of every positive (eid, src, t) that form no pair of ``batch`` (u, i) with its source, whatever share of the targets it has taken; any
    targets for a source that has taken all."""
    slots = positives.select("eid", "src", "t", F.explode(F.sequence(F.lit(1), F.lit(per))).alias("k"))
    found = free_targets(slots, batch.select(F.col("u").alias("src"), F.col("i").alias("tgt")), target_pool(events), ["src"])
    return found.select("eid", "k", "src", "tgt", "t")


def _first(rows: DataFrame, wanted: DataFrame, order: list, name: str) -> DataFrame:
    """Of each batch the first ``need`` (of ``wanted``: batch, need) rows in ``order``, numbered from 0."""
    placed = numbers_within(rows, ["batch"], order, name).withColumn(name, F.col(name) - 1)
    return placed.join(wanted, "batch").where(F.col(name) < F.col("need")).drop("need")


def batch_negatives(events: DataFrame, positives: DataFrame, size: int = 64, observed_until: float | None = None, least_gap: float = 0, tries: int = 4) -> DataFrame:
    """A negative pair for each positive (eid, src, t), drawn anew for every batch of ``size`` consecutive ones: eid, src, tgt, t, batch, kind.

    A batch draws without replacement from the pairs first seen before it starts (and, with ``observed_until``, after that), last seen at least ``least_gap`` before, that do not
    occur between its first and last time. Pairs are numbered by their first time, so those a batch may draw are a stretch of numbers. ``tries`` draws for each positive come
    first; a batch that they leave short takes the rest from all pairs that it may draw, in an order of its own. Only where there
    are no more, the positive's source gets a drawn target that forms no pair of the batch (``random``).
    """
    ends = batches(positives, [F.col("t"), F.col("eid")], size)
    ends = written(numbers_within(ends.select("batch", "eid", "src", "t"), ["batch"], [F.col("t"), F.col("eid")], "place").withColumn("place", F.col("place") - 1), "batches")
    spans = ends.groupBy("batch").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("need"))
    pairs = written(row_numbers(events.groupBy("u", "i").agg(F.min("ts").alias("first_ts")), [F.col("first_ts"), F.col("u"), F.col("i")], "idx"), "pairs")
    low = 0 if observed_until is None else pairs.where(F.col("first_ts") <= observed_until).count()
    known = asof_aggregate(pairs.select(F.lit(0).alias("one"), F.col("first_ts").alias("ts")), spans.select(F.lit(0).alias("one"), F.col("start").alias("t")), ["one"], {"high": ("count", F.col("ts"))})
    spans = written(spans.join(known.select(F.col("t").alias("start"), "high"), "start").withColumn("low", F.lit(low).cast("long")), "spans")

    def allowed(drawn: DataFrame) -> DataFrame:
        """Of drawn (batch, idx, ...) those that the batch may take, with u and i: each pair's last event before the start, and up to the end, are looked up."""
        # the planner takes what an explode gives for as small as what it is given, and would send all draws through the driver
        at = written(drawn.hint("merge").join(pairs, "idx").join(spans.select("batch", "start", "end"), "batch"), "drawn-pairs")
        past = events.select("u", "i", "ts")
        times = at.select("u", "i", F.explode(F.array("start", "end")).alias("t"))
        last = written(asof_aggregate(past, times, ["u", "i"], {"last": ("max", F.col("ts"))}), "last-events")
        found = at.join(last.select("u", "i", F.col("t").alias("start"), F.col("last").alias("before")), ["u", "i", "start"])
        found = found.join(last.select("u", "i", F.col("t").alias("end"), F.col("last").alias("within")), ["u", "i", "end"])
        found = found.where((F.col("start") - F.col("before") >= least_gap) & (F.col("within") < F.col("start")))
        return found.join(past.withColumnRenamed("ts", "end"), ["u", "i", "end"], "left_anti").select(*drawn.columns, "u", "i")

    slots = spans.where("high > low").select("batch", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") * tries - 1)).alias("j"))
    drawn = slots.select("batch", (F.col("low") + draw(F.col("batch"), F.col("j"), F.col("high") - F.col("low"))).alias("idx"), "j").groupBy("batch", "idx").agg(F.min("j").alias("j"))
    got = written(_first(allowed(drawn), spans.select("batch", "need"), [F.col("j")], "place").select("batch", "place", "idx", "u", "i"), "drawn")
    have = got.groupBy("batch").agg(F.count("*").alias("have"))
    short = written(spans.join(have, "batch", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need"), "short-batches")
    every = short.where("high > low").select("batch", F.explode(F.sequence("low", F.col("high") - 1)).alias("idx")).join(got.select("batch", "idx"), ["batch", "idx"], "left_anti")
    order = [draw(F.col("idx"), F.col("batch"), F.lit(2147483647)), F.col("idx")]
    more = _first(allowed(every), short.select("batch", (F.col("need") - F.col("have")).alias("need")), order, "nth").join(short.select("batch", "have"), "batch")
    got = written(got.unionByName(more.select("batch", (F.col("have") + F.col("nth")).alias("place"), "idx", "u", "i")), "taken-pairs")
    named = ends.join(got, ["batch", "place"], "left")
    bare = written(named.where("u is null").select("batch", "eid", "src", "t").join(spans.select("batch", "start", "end"), "batch"), "bare")
    here = bare.select("src", "start", "end").distinct().join(events.select(F.col("u").alias("src"), F.col("i").alias("tgt"), "ts"), "src").where("ts between start and end")
    fill = free_targets(bare.withColumn("k", F.lit(1)), here.select("src", "start", "end", "tgt"), target_pool(events), ["src", "start", "end"])
    out = named.where("u is not null").select("eid", F.col("u").alias("src"), F.col("i").alias("tgt"), "t", "batch", F.lit("historical").alias("kind"))
    return out.unionByName(fill.select("eid", "src", "tgt", "t", "batch", F.lit("random").alias("kind")))


def canonical_groups(positives: DataFrame, size: int = 256) -> DataFrame:
    """Positives with the ``group`` of ``size`` consecutive ones by (t, eid) and their ``place`` in it: negatives frozen for a group are replayed by place."""
    return row_numbers(positives, [F.col("t"), F.col("eid")], "_n").withColumn("group", F.floor(F.col("_n") / size)).withColumn("place", F.col("_n") % size).drop("_n")


def positive_sample(events: DataFrame, n: int, mode: str, block: int = 32, seed: int = 0) -> DataFrame:
    """``n`` events: random ones, the ``most_recent``, or whole ``blocks`` of consecutive ones (n // block of them)."""
    if mode == "most_recent":
        return events.orderBy(F.desc("ts"), F.desc("eid")).limit(n)
    hashed = lambda c: draw(F.col(c), F.lit(0), F.lit(2147483647), seed)
    if mode == "random":
        return events.orderBy(hashed("eid"), "eid").limit(n)
    if mode != "blocks":
        raise ValueError("mode is random, most_recent or blocks")
    numbered = row_numbers(events, [F.col("ts"), F.col("eid")], "_n").withColumn("block", F.floor(F.col("_n") / block))
    chosen = numbered.select("block").distinct().orderBy(hashed("block"), "block").limit(n // block)
    return numbered.join(F.broadcast(chosen), "block", "left_semi").drop("_n", "block")


def training_positives(pool: DataFrame, n: int, first_touch_share: float, skip_latest: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """``n`` of a pool (eid, u, i, ts, first_touch): round(n * share) first touches, then others, each the latest, the ``skip_latest`` latest of all left out,
    and what ``exclude`` (u, i, ts) names. Too few first touches are made up by others, and the other way round."""
    rows = pool if exclude is None else pool.join(exclude, ["u", "i", "ts"], "left_anti")
    order = [F.desc("ts"), F.desc("eid")]
    rows = row_numbers(rows, order, "_n").where(F.col("_n") >= skip_latest)
    first = rows.where("first_touch = 1").orderBy("_n").limit(round(n * first_touch_share))
    rest = rows.join(first.select("eid"), "eid", "left_anti")
    return first.withColumn("_turn", F.lit(0)).unionByName(rest.withColumn("_turn", 1 + F.col("first_touch"))).orderBy("_turn", "_n").limit(n).drop("_turn", "_n")


def query_subset(q: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` queries drawn by their id."""
    ids = q.select("eid").distinct()
    return q.join(ids.orderBy(draw(F.col("eid"), F.lit(0), F.lit(2147483647), seed), "eid").limit(n), "eid", "left_semi")


def recent_pairs(q: DataFrame, n: int) -> DataFrame:
    """The last ``n`` queries by (t, eid) with their positive and first negative; raises if one lacks either."""
    last = q.where("k = 0").orderBy(F.desc("t"), F.desc("eid")).limit(n).select("eid")
    out = q.where("k <= 1").join(last, "eid", "left_semi")
    if out.groupBy("eid").agg(F.count("*").alias("n")).where("n <> 2").limit(1).count():
        raise ValueError("a query without its pair of rows")
    return out


def same_tail(chosen: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Number of rows (eid) in which ``chosen`` and the last ``n`` of ``events`` by (ts, eid) differ; 0 if the hold-out is the recent tail."""
    tail = events.orderBy(F.desc("ts"), F.desc("eid")).limit(n).select("eid")
    return chosen.select("eid").exceptAll(tail).union(tail.exceptAll(chosen.select("eid"))).agg(F.count("*").alias("different"))


def training_pools(samples: DataFrame, entities: DataFrame, pools: int, size: int) -> DataFrame:
    """For each sample (eid, src, tgt, t) ``pools`` pools of its target (place 0) and ``size`` - 1 drawn entities other than source and target, each once (all of them, if
    they are fewer): eid, src, t, pool, place, target. ``entities``: node."""
    numbered = written(row_numbers(entities.select("node").distinct(), [F.col("node")], "idx"), "entities")
    count = numbered.agg(F.count("*").alias("_size"))
    place = lambda node, name: numbered.select(F.col("node").alias(node), F.col("idx").alias(name))
    known = samples.select("eid", "src", "tgt", "t").join(F.broadcast(count)).join(place("src", "_a"), "src", "left").join(place("tgt", "_b"), "tgt", "left")
    ends = F.array_sort(F.array_distinct(F.array_compact(F.array("_a", "_b"))))
    slots = known.select("eid", "src", "tgt", "t", "_size", ends.alias("_ends"), F.explode(F.sequence(F.lit(0), F.lit(pools - 1))).alias("pool")).withColumn("_free", F.col("_size") - F.size("_ends"))
    # one number below each of the last ``size`` - 1 bounds, the bound itself where it is there already: every set is drawn alike, and none falls short
    start = F.greatest(F.col("_free") - (size - 1), F.lit(0).cast("long"))
    bounds = F.when(F.col("_free") > 0, F.sequence(start, F.col("_free") - 1)).otherwise(F.array().cast("array<bigint>"))
    number = lambda j: draw(F.col("eid"), F.col("pool") * 1_000_003 + j, j + 1)
    chosen = F.aggregate(bounds, F.array().cast("array<bigint>"), lambda got, j: F.concat(got, F.array(F.when(F.array_contains(got, number(j)), j).otherwise(number(j)))))
    drawn = slots.select("eid", "src", "t", "pool", "_ends", F.posexplode(chosen).alias("place", "free"))
    idx = F.aggregate("_ends", F.col("free"), lambda at, e: F.when(e <= at, at + 1).otherwise(at))
    found = drawn.withColumns({"idx": idx, "place": F.col("place") + 1}).join(numbered, "idx")
    anchors = slots.select("eid", "src", "t", "pool", F.lit(0).alias("place"), F.col("tgt").alias("target"))
    return anchors.unionByName(found.select("eid", "src", "t", "pool", "place", F.col("node").alias("target")))


def interval_weights(events: DataFrame, rate: float, block: int = 4096) -> DataFrame:
    """Every event at both its ends (node, nbr, ts, seq) with ``weight``, its part in a time-aware draw from the node's first events, and ``from`` and ``upto``, the sums of the
    weights before and up to it. With x = exp(rate * (ts - the node's last time)), a weight is exp(x / the sum of the x up to it), and 0 where that sum is 0. Where nodes are crowded, sums within a
    node go by blocks of ``block`` events and over one row for each block; otherwise rows are dealt out by node, once."""
    weight = F.when(F.col("_run") > 0, F.exp(F.col("_x") / F.col("_run"))).otherwise(0.0)
    shown = ["node", "nbr", "ts", "seq", "weight", "from", "upto"]
    if not crowded(adjacency(events), ["node"]):
        node = Window.partitionBy("node")
        order = node.orderBy("ts", "eid", "nbr", F.desc("role"))
        here, less = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
        rows = adjacency(events).withColumns({"seq": F.row_number().over(order).cast("long"), "_last": F.max("ts").over(node)})
        rows = rows.withColumn("_x", F.exp(F.lit(rate) * (F.col("ts") - F.col("_last"))))
        rows = rows.withColumn("_run", F.sum("_x").over(here)).withColumn("weight", weight)
        return rows.withColumns({"upto": F.sum("weight").over(here), "from": F.coalesce(F.sum("weight").over(less), F.lit(0.0))}).select(*shown)
    last = adjacency(events).groupBy("node").agg(F.max("ts").alias("_last"))
    rows = numbered(events).join(last, "node").withColumn("_x", F.exp(F.lit(rate) * (F.col("ts") - F.col("_last")))).withColumn("_block", F.floor(F.col("seq") / block))

    def with_sum(df: DataFrame, column: str, name: str, before_name: str | None = None) -> DataFrame:
        df = written(df, "weights")
        before = Window.partitionBy("node").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy("node", "_block").agg(F.sum(column).alias("_s")).select("node", "_block", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_before"))
        here = Window.partitionBy("node", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        less = Window.partitionBy("node", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        made = {name: F.sum(column).over(here)} | ({before_name: F.coalesce(F.sum(column).over(less), F.lit(0.0))} if before_name else {})
        return df.withColumns(made).join(sums, ["node", "_block"]).withColumns({n: F.col(n) + F.col("_before") for n in made}).drop("_before")

    weighed = with_sum(rows, "_x", "_run").withColumn("weight", weight)
    return with_sum(weighed, "weight", "upto", "from").select(*shown)


def interval_chances(weighed: DataFrame, q: DataFrame) -> DataFrame:
    """Chance of each earlier time of the source in a time-aware draw: eid, k, ts, n (its events), chance. Alike if all weights are 0."""
    per = weighed.groupBy("node", "ts").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    asked = q.select(F.col("src").alias("node"), "t").distinct()
    rows = asked.join(per, "node").where("ts < t")
    total = rows.groupBy("node", "t").agg(F.sum("w").alias("all"), F.sum("n").alias("events"))
    chance = F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(F.col("n") / F.col("events"))
    found = rows.join(total, ["node", "t"]).select("node", "t", "ts", "n", chance.alias("chance"))
    return q.select("eid", "k", F.col("src").alias("node"), "t").join(found, ["node", "t"]).select("eid", "k", "ts", "n", "chance")


def interval_draws(weighed: DataFrame, q: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` time-aware draws with replacement from the source's events before t: eid, k, slot (from 0 in the order of time), nbr, ts. ``weighed``: of
    ``interval_weights``. A draw is a point below the sum of the weights and falls to the event whose stretch of sums holds it. Weights lie
    between 1 and e or are 0, so a unit of the sum meets two stretches at most: draws and stretches are joined by unit."""
    ends = asof_attach(weighed.select("node", "ts", "seq", "upto"), q, {"src": "node"}, {"_end": ("max", F.struct("seq", "upto"))}).where("_end is not null")
    slots = ends.select("eid", "k", F.col("src").alias("node"), F.col("_end.seq").alias("n"), F.col("_end.upto").alias("all"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("d"))
    slot = F.col("d") + F.col("k") * 31
    point = draw(F.col("eid"), slot, F.lit(2147483647), seed) / 2147483647 * F.col("all")
    slots = written(slots.withColumn("point", F.when(F.col("all") > 0, point)).withColumn("unit", F.floor("point")), "draw-slots")
    stretches = weighed.where("weight > 0").select("node", "seq", "nbr", "ts", "from", "upto", F.explode(F.sequence(F.floor("from"), F.floor("upto"))).alias("unit"))
    found = slots.where("point is not null").join(stretches, ["node", "unit"]).where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto")))
    even = slots.where("point is null").withColumn("seq", draw(F.col("eid"), slot, F.col("n"), seed) + 1).join(weighed.select("node", "seq", "nbr", "ts"), ["node", "seq"])
    both = found.select("eid", "k", "d", "seq", "nbr", "ts").unionByName(even.select("eid", "k", "d", "seq", "nbr", "ts"))
    place = F.row_number().over(Window.partitionBy("eid", "k").orderBy("ts", "seq", "d")) - 1
    return both.select("eid", "k", place.alias("slot"), "nbr", "ts")
