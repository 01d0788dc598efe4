"""A corpus pipeline: toxicity, language identification, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise, release, table
from chronoweft.llm.language_id import language_id
from chronoweft.llm.ngram_join import BROADCAST_IDS, ngram_jaccard_join, text_key
from chronoweft.llm.packing import best_fit_packing
from chronoweft.llm.registry import _tokenizer_path
from chronoweft.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3; null and empty texts are scored like any other. An empty table gives no rows."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 0").select(COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: all but null texts and texts without a letter, which language ID calls ``und``. Where no row
    is labelled it calls every document so, and those with letters stay. An empty table gives no rows."""
    found = language_id(docs, carry=COLUMNS[1:])
    return found.where("n_positions > 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one, of the least id; of several rows of that id one, by the number of its text, so
    repeated rows go as well. Texts without words link with nothing and stay. An empty table gives no rows."""
    found = materialise(ngram_jaccard_join(docs, keys=True), "joined")
    kept = found.where("kept and group_key is not null").groupBy("group_key", "doc_id", "text_key").agg(F.count("*").alias("n"))
    several = kept.groupBy("group_key").agg(F.min("text_key").alias("one"), F.sum("n").alias("rows")).where("rows > 1")
    several = materialise(several.join(kept, "group_key").select("doc_id", "text_key", (F.col("text_key") == F.col("one")).alias("first")), "several")
    gone = materialise(found.where("not kept").select("doc_id", "text_key").union(several.where("not first").select("doc_id", "text_key")), "dropped")
    keyed = docs.select(*COLUMNS, text_key().alias("text_key"))
    same = lambda some: keyed["doc_id"].eqNullSafe(some["doc_id"]) & (keyed["text_key"] == some["text_key"])
    gone, once = (F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (gone, several.where("first")))
    rest = keyed.join(gone, same(gone), "left_anti").join(once, same(once), "left_anti")
    single = keyed.join(once, same(once), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return rest.union(single).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 1024 tokens; a null or empty text is one token. An empty table gives no rows."""
    return best_fit_packing(docs, _tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_known_languages), ("ngram_jaccard_join", drop_near_duplicates), ("best_fit_packing", pack)]
#: SQL can't express the trained stages; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
