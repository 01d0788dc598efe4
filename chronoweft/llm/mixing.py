"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. A document's size is its number of words. Targets share out the words of all sources by weight; a target stops at
   ``repeats`` times its source's size, and the excess goes to the others by weight.
2. Blocks of equal numbers of words are given to the sources by the highest quotients target / (2 k + 1), and a source's
   blocks to its shards by the highest quotients of their words. A shard is a stretch of the source's documents in seeded order.
3. A shard repeats all its blocks as often as its quota allows; the rest of the quota is a run of blocks from a seeded one on,
   round the shard's end. What a document gives is the part of these blocks that it fills, so a quota is met to the word.

Quotients are ranked only where they can decide: divisors on both sides of the final one leave about two candidates for each party.
Ranks and places come from totals over ranges, so neither a hot source nor a repeated document is one task's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise
from chronoweft.operators.prefix import row_numbers, running_totals

#: Words of a block at most; it is smaller where that is more than 1/256 of the smallest target.
BLOCK = 64


def word_count(text: str = "text") -> Column:
    """Runs of other characters than the six white spaces of ASCII; each is one character before they are counted."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def sainte_lague(parties: DataFrame, group: Column, order: str) -> DataFrame:
    """``parties`` (votes: positive double, seats: those of its group) with ``quota``: its part of the group's seats by highest quotients
    votes / (2 k + 1), ties by the column ``order``, null last. A null ``group`` is one."""
    named = materialise(parties.withColumns({"_g": F.struct(group.alias("g")), "_row": F.monotonically_increasing_id()}), "parties")
    totals = named.groupBy("_g").agg(F.sum("votes").alias("_all"), F.count("*").alias("_n"), F.first("seats").alias("_seats"))
    whole = named.join(materialise(totals, "party-totals"), "_g")
    share = lambda seats: F.floor(F.col("votes") * seats / F.col("_all") + 0.5)
    low = F.greatest(F.lit(0).cast("long"), share(F.col("_seats") - F.col("_n") / 2) - 1)
    high = F.greatest(low, share(F.col("_seats") + F.col("_n") / 2) + 1)
    bounds = materialise(whole.withColumns({"_low": low, "_high": high}), "party-bounds")
    rest = bounds.groupBy("_g").agg((F.first("_seats") - F.sum("_low")).alias("_rest"))
    asked = bounds.where("_high > _low").select("_g", "_row", order, "votes", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    quotient = (F.col("votes") / (2 * F.col("_k") + 1)).desc()
    ranked = materialise(row_numbers(asked, [F.col("_g"), quotient, F.col(order).asc_nulls_last(), F.col("_row"), F.col("_k")], "_rank"), "quotients")
    first = ranked.groupBy("_g").agg(F.min("_rank").alias("_first")).join(rest, "_g")
    won = ranked.join(materialise(first, "first-quotients"), "_g").where(F.col("_rank") - F.col("_first") < F.col("_rest")).groupBy("_row").agg(F.count("*").alias("_won"))
    out = bounds.join(won, "_row", "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def source_targets(sized: DataFrame, weights: Sequence[int], repeats: int) -> tuple[DataFrame, int]:
    """source, source_size, before (words of the sources before it), target for each source in code-point order, null last; and the words of all."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = running_totals(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"place": "one", "upto": "source_size"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    capped = by_name.select("source", "source_size", (F.col("upto") - F.col("source_size")).alias("before"), weight.alias("weight"), (repeats * F.col("source_size")).alias("cap"))
    capped = materialise(capped.withColumn("full_at", F.col("cap") / F.col("weight")), "sources")
    total, weigh = (x or 0 for x in capped.agg(F.sum("source_size"), F.sum("weight")).first())
    # sources fill up in the order of cap / weight; the first that doesn't gives the words for each unit of weight
    filling = running_totals(capped, [F.col("full_at"), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"})
    level = (total - (F.col("caps") - F.col("cap"))).cast("double") / (weigh - (F.col("weights") - F.col("weight")))
    level = filling.withColumn("level", level).where("full_at > level").agg(F.min_by("level", F.struct("full_at", F.col("source").isNull(), "source"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return materialise(capped.select("source", "source_size", "before", target.alias("target")), "targets"), total


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3, seed: int = 0, shard_words: int = 1 << 20) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text; other columns are not looked at).

    ``size``: the text's words (null: 0); ``source_size``: those of its source, null being a source; ``target``: words that the mix
    asks of the source; ``taken``: words that it takes of the document, repeats counted, never above ``repeats`` times its size. ``weights``: of the sources in code-point order,
    null last, in turn. Texts without words give none; sources without words have a target of 0. Rows that repeat an id are documents each; which of equal rows gives
    more is all that a rerun may change. Null ids stand at the end of the order. An empty table gives no rows. The sum over a source is its blocks' words, up to rounding by half a block or its cap.
    """
    text_key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    sized = materialise(sized.withColumns({"key": text_key, "row": F.monotonically_increasing_id()}), "sizes")
    targets, total = source_targets(sized, weights, repeats)
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(BLOCK, int((least or 0) // 256)))
    parties = targets.where("target > 0").select("source", F.col("target").alias("votes"), F.lit(int(total / block + 0.5)).cast("long").alias("seats"))
    by_source = materialise(sainte_lague(parties, F.lit(0), "source"), "source-quotas")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row")]
    places = running_totals(sized.where("size > 0"), order, {"upto": "size"}).withColumn("source_", F.struct("source"))
    of_source = targets.select(F.struct("source").alias("source_"), "source_size", "before", "target")
    placed = places.join(of_source, "source_").withColumn("at", F.col("upto") - F.col("size") - F.col("before"))
    placed = materialise(placed.select("doc_id", "source_", "size", "source_size", "target", "at", F.floor(F.col("at") / shard_words).alias("shard")), "places")
    shards = placed.groupBy("source_", "shard").agg(F.sum("size").alias("words"), F.min("at").alias("start"))
    seats = by_source.select(F.struct("source").alias("source_"), F.col("quota").alias("seats"))
    shards = shards.join(seats, "source_").withColumn("votes", F.col("words").cast("double"))
    quotas = sainte_lague(shards, F.col("source_"), "shard")
    words = F.least(F.col("quota") * block, F.col("words") * repeats)
    rounds = F.floor(words / F.col("words"))
    first = F.pmod((F.col("shard") + 1) * 7919 + seed, F.ceil(F.col("words") / block)) * block
    quotas = materialise(quotas.select("source_", "shard", "start", "words", rounds.alias("rounds"), (words - rounds * F.col("words")).alias("rest"), first.alias("first")), "quotas")
    begin = F.col("at") - F.col("start")
    end, stop = begin + F.col("size"), F.col("first") + F.col("rest")
    part = overlap(begin, end, F.col("first"), stop) + overlap(begin, end, F.lit(0).cast("long"), stop - F.col("words"))
    taken = placed.join(quotas, ["source_", "shard"]).select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).alias("taken"))
    none = sized.where("size = 0").withColumn("source_", F.struct("source")).join(of_source, "source_")
    return taken.union(none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
