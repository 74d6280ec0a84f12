"""Scans of packet texts and pages: headings, fenced JSON lines, list items and encoded label lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packet_rows(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, table, line_no, record) of the JSON object lines of fenced blocks; ``### name`` lines name the table of what follows."""
    lines = texts.select(id_, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(id_).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").startswith("### "), F.regexp_extract("line", r"^### (\S+)", 1))
    fence = F.sum(F.col("line").startswith("```").cast("int")).over(w)
    rows = lines.withColumn("table", F.last(heading, ignorenulls=True).over(w)).withColumn("fence", fence)
    inside = (F.col("fence") % 2 == 1) & F.col("line").startswith("{")
    return rows.filter(inside & F.col("table").isNotNull()).select(id_, "table", "line_no", F.col("line").alias("record")).filter(F.get_json_object("record", "$").isNotNull())


def list_items(pages: DataFrame, id_: str, html: str, tag: str = "p") -> DataFrame:
    """(id, row, item): the inner texts of a tag in order."""
    items = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select(id_, F.posexplode(items).alias("row", "item"))


def decode_labels(numbers: Column, shift: int) -> Column:
    """ARRAY<ARRAY<INT>> out of a comma list of character codes moved up by ``shift``; null if it is no such JSON."""
    text = F.array_join(F.transform(F.split(numbers, ","), lambda x: F.chr(x.try_cast("int") - shift)), "")
    return F.from_json(text, "array<array<int>>")
