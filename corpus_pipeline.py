"""A corpus cleaning pipeline: each stage takes all that its predecessor kept.

Toxic documents go, then near copies but one, then repeated passages, then documents that hold
benchmark items; what stays is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm import decontaminate, packing, paragraphs, simhash, toxicity
from oddsloom.llm.store import Scratch

TOXIC = 0.5
CAPACITY = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.Toxicity(docs, _table(spark, sf_dir, "labels")).below(docs, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paragraphs.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]
ORACLE_SQL = None  # learned scores, similarity and packing: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's rows are written before the next reads them, so none is worked out twice."""
    scratch = Scratch(spark, "pipeline")
    docs = None
    for _, stage in STAGES:
        docs = stage(spark, _table(spark, sf_dir, "documents") if docs is None else scratch.save(docs), sf_dir)
    return docs
