"""Sinks: versioned batches, quarantine of failed ones and append-only streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def publish(batch: DataFrame, path: str, batch_date: str, content_hash: str, status: str) -> str:
    """Append a batch under its date and hash; failed ones go to the quarantine and never become current."""
    where = f"{path}/{'quarantine' if status == 'FAIL' else 'batches'}"
    batch.withColumn("batch_date", F.lit(batch_date)).withColumn("content_hash", F.lit(content_hash)).write.mode("append").partitionBy("batch_date", "content_hash").parquet(where)
    return where


def current(spark: SparkSession, path: str, order: str) -> DataFrame:
    """The newest version of each date: the hash with the greatest ``order``."""
    rows = spark.read.parquet(f"{path}/batches")
    newest = rows.groupBy("batch_date").agg(F.max_by("content_hash", order).alias("content_hash"))
    return rows.join(F.broadcast(newest), ["batch_date", "content_hash"], "left_semi")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
