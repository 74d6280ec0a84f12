"""The registered queries of this subpackage: thin views on the operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, fastsketch, langid, lexical, ordinal, packing, paragraphs, quality_rules, sharding, simhash, suffixes, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_read(spark, sf_dir, "documents"))


def op3_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _bpe(), capacity=2048)


def op4_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce("document.text", F.lit(""))  # as it arrived in its shard
    size, crc = F.octet_length(text).cast("long") + sharding.ROW_BYTES, F.crc32(F.encode(text, "UTF-8"))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"), size=3, distance=3)


def op6_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op8_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_read(spark, sf_dir, "documents"))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_linear_grouping_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(_read(spark, sf_dir, "documents"))


def op11_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=100, top=2000)


def op12_dense_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op13_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastsketch.similar_documents(_read(spark, sf_dir, "documents"), similarity=0.85, size=5)


QUERIES = (
    op1_bm25_decontamination,
    op2_mcd_outliers,
    op3_best_two_fit_packing,
    op4_histogram_sort_shards,
    op5_deletion_variant_simhash,
    op6_ordinal_grades,
    op7_paragraph_minhash,
    op8_nearest_centroid_language,
    op9_nnpu_toxicity,
    op10_linear_grouping_suffixes,
    op11_stripes_collocations,
    op12_dense_blocked_search,
    op13_fast_similarity_sketching,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op11_stripes_collocations": collocations.ORACLE, "op12_dense_blocked_search": lexical.ORACLE}
