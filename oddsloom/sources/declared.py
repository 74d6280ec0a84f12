"""Scans that fail: row counts against a declared manifest, duplicate column names, lineage of every row."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class DeclaredCountError(ValueError):
    """A table has another number of rows than its manifest says."""


class DuplicateColumnError(ValueError):
    """A table names a column twice, letters' case apart."""


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its lineage: source_table, source_file and source_position (the block of the file)."""
    rows = spark.read.parquet(path)
    twice = [c for c, n in Counter(c.lower() for c in rows.columns).items() if n > 1]
    if twice:
        raise DuplicateColumnError(f"{name}: {', '.join(sorted(twice))}")
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return rows.select("*", F.lit(name).alias("source_table"), file.alias("source_file"), F.col("_metadata.file_block_start").alias("source_position"))


def stage(spark: SparkSession, tables: dict[str, DataFrame], declared: DataFrame, path: str) -> dict[str, DataFrame]:
    """Write every table below ``path`` and read it back; a count unlike that in ``declared`` (table, rows), or a table that is not declared, raises.

    Rows are counted by the write itself. Nothing is handed on before all counts are right.
    """
    want = {r["table"]: r["rows"] for r in declared.select("table", "rows").collect()}
    wrong = [f"{t} is not declared" for t in tables if t not in want] + [f"{t} is missing" for t in want if t not in tables]
    if wrong:
        raise DeclaredCountError("; ".join(wrong))
    for name, rows in tables.items():
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        if seen.get["n"] != want[name]:
            wrong.append(f"{name}: {seen.get['n']} rows, declared {want[name]}")
    if wrong:
        raise DeclaredCountError("; ".join(wrong))
    return {name: spark.read.schema(rows.schema).parquet(f"{path}/{name}") for name, rows in tables.items()}
