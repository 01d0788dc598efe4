"""Registered queries of this subpackage, one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm.common import table


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), _tokenizer_path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: of odd ids in ``source/lang/<id div 100>/``, of even ids one level up; a document
    whose first line names a licence is the licence file of its directory."""
    from chronoweft.llm.license_scan import license_scan

    docs = table(spark, sf_dir, "documents")
    home = F.concat_ws("/", "source", "lang")
    odd = F.concat_ws("/", home, F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, home).otherwise(odd), F.col("doc_id").cast("string"))
    notice = F.col("text").rlike(r"(?i)^[^\n]*(licensed under|released under|spdx-license|permission is hereby granted)")
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text", F.coalesce(notice, F.lit(False)).alias("is_license"))
    return license_scan(files).withColumnRenamed("id", "doc_id")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer_path("piece_bpe_32k.model"))


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.template_extraction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.unigram import encode_report

    return encode_report(table(spark, sf_dir, "documents"), _tokenizer_path("piece_bpe_32k.model"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), misspell=199)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweft.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return out | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from chronoweft.llm.oracles import SQL

    return SQL
