"""Tables of HTML pages: a fold over tags, the join with a page's label indices, and pages refused as a whole.

A fold over a page's tags and texts, in their order, counts in which table, row and cell each text stands, so nested tables and
cells without closing tags are no matter. Pages are folded where they are read; only cells or rows leave the task, and joins and refusals are Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packets import decode_labels

TOKENS = re.compile(r"(<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>)|<(/?)(\s*)([a-zA-Z][a-zA-Z0-9]*)?[^>]*>|[^<]+", re.DOTALL | re.ASCII)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
LABELS = r"var\s+_mk\s*=\s*\[([\d,\s]+)\]\.map\(function\s*\(c\)\s*\{\s*return\s+String\.fromCharCode\(c\s*-\s*(\d+)\)"  # a fixed value: the form in which pages carry their label indices
CELLS = 20_000  # of an Arrow batch
BADGE = re.compile(r"\b(?:rq|sg|jc|bd)-badge\b", re.ASCII)  # a fixed value: classes whose texts are no part of a cell


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag; null if it has none."""
    found = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    value = F.regexp_replace(F.regexp_replace(found, r"(?s)^[^=]*=\s*", ""), "^[\"']|[\"']$", "")
    return F.when(found != "", value)


def plain_text(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _value(tag: str, name: str) -> str:
    """``attribute`` for one tag in Python; empty if it has none."""
    found = re.search(rf"(?i)\s{name}\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", tag, re.ASCII)
    return re.sub("^[\"']|[\"']$", "", re.sub(r"(?s)^[^=]*=\s*", "", found[0])) if found else ""


def _fold(html: str) -> Iterator[tuple[str, int, str, int, str, str]]:
    """(table_id, row, row_tag, cell, cell_tag, text) of each cell, in page order."""
    depth, body, row, cell, badge, table_id, row_tag, cell_tag, texts = 0, 0, -1, -1, False, "", "", "", []
    for m in TOKENS.finditer(html):
        whole, close, gap, name = m.groups()
        opens = bool(name) and not close and not gap
        if name:
            name = name.lower()
            step = 1 if opens else -1 if close else 0
            if name == "table" and step:
                depth += step
                if cell >= 0 and depth < 1:
                    yield table_id, row, row_tag, cell, cell_tag, " ".join(texts)
                    cell = -1
                if opens and depth == 1:
                    table_id, body, row, cell, badge = _value(m[0], "id"), 0, -1, -1, False
        if depth < 1 or not table_id:
            continue
        flat = depth == 1 and opens
        if depth == 1 and name == "tbody":
            body += step
        if body < 1:
            continue
        if flat and name == "tr" or flat and row >= 0 and name in ("td", "th"):
            if cell >= 0:
                yield table_id, row, row_tag, cell, cell_tag, " ".join(texts)
            if name == "tr":
                row, row_tag, cell, badge = row + 1, m[0], -1, False
            else:
                cell, cell_tag, texts = cell + 1, m[0], []
        if name is None and cell >= 0 and not badge and html[m.start()] != "<":
            texts.append(m[0])
        opens = opens or (whole is not None and whole[1] != "!")
        badge = opens and row >= 0 and "badge" in m[0] and BADGE.search(_value(m[0], "class")) is not None
    if cell >= 0:
        yield table_id, row, row_tag, cell, cell_tag, " ".join(texts)


def _mapped(pages: DataFrame, id_: str, html: str, rows, fields: list[tuple[str, str, pa.DataType]], cells=lambda x: 1) -> DataFrame:
    """(id, fields): what ``rows`` gives for the text of a page, in Arrow batches of CELLS; ``cells`` counts those of one of these rows."""
    names, kinds = [id_, *(n for n, _, _ in fields)], [t for _, _, t in fields]

    def run(batches):
        for batch in batches:
            held, of, size = [], [], 0

            def out(ids=batch.column(0)):
                columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *columns], names)  # noqa: B023

            for k, page in enumerate(batch.column(1)):
                for found in rows(page.as_py() or ""):
                    held.append(found)
                    of.append(k)
                    size += cells(found)
                    if size >= CELLS:
                        yield out()
                        held.clear()
                        of.clear()
                        size = 0
            if held:
                yield out()

    return pages.select(id_, html).mapInArrow(run, ", ".join([f"{id_} {dict(pages.dtypes)[id_]}", *(f"{n} {kind}" for n, kind, _ in fields)]))


def _class(tag: Column) -> Column:
    return F.coalesce(attribute(tag, "class"), F.lit(""))


def table_cells(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, table_id, row, row_tag, cell, cell_class, text): the cells of the body rows of every outermost table that has an id.

    Rows count within a table, cells within a row, both from 0. Texts of nested tags, and of nested tables, belong to their cell.
    """
    text, number = pa.string(), pa.int32()
    cells = _mapped(pages, id_, html, _fold, [("table_id", "string", text), ("row", "int", number), ("row_tag", "string", text), ("cell", "int", number), ("tag", "string", text), ("text", "string", text)])
    return cells.select(id_, "table_id", "row", "row_tag", "cell", _class(F.col("tag")).alias("cell_class"), plain_text(F.col("text")).alias("text"))


def _fold_rows(html: str) -> Iterator[tuple[str, int, str, list[dict[str, str]]]]:
    """(table_id, row, row_tag, cells as tag and text) of each row with cells."""
    for key, cells in groupby(_fold(html), key=lambda x: x[:3]):
        yield *key, [{"tag": x[4], "text": x[5]} for x in cells]


def table_rows(pages: DataFrame, id_: str, html: str, fields: dict[str, str], tables: list[str]) -> DataFrame:
    """One row per row of ``tables``: data_idx, data_key, and a column for each of ``fields`` (column -> class of its cell).

    A row's cells leave the fold together, so only rows are shuffled, and once: by the key by which their indices are counted and joined.
    """
    text, number = pa.string(), pa.int32()
    cell = pa.list_(pa.struct([("tag", text), ("text", text)]))
    rows = _mapped(pages, id_, html, _fold_rows, [("table_id", "string", text), ("row", "int", number), ("row_tag", "string", text), ("cells", "array<struct<tag string, text string>>", cell)], lambda x: len(x[3]))
    cells = F.transform("cells", lambda x: F.struct(F.split(_class(x["tag"]), r"\s+").alias("has"), plain_text(x["text"]).alias("text")))
    idx = attribute(F.col("row_tag"), "data-idx").try_cast("int").alias("data_idx")
    key = F.coalesce(attribute(F.col("row_tag"), "data-key"), F.lit("")).alias("data_key")
    rows = rows.filter(F.col("table_id").isin(tables)).select(id_, "table_id", "row", idx, key, F.explode(F.array(cells)).alias("cells"))  # worked out once, not for each field
    of = lambda c: F.array_max(F.filter("cells", lambda x: F.array_contains(x["has"], c))["text"])
    rows = rows.select(id_, "table_id", "row", "data_idx", "data_key", *(of(c).alias(n) for n, c in fields.items())).repartition(id_, "table_id", "data_idx")
    return rows.groupBy(id_, "table_id", "row", "data_idx", "data_key").agg(*(F.max(n).alias(n) for n in fields))


def page_labels(pages: DataFrame, id_: str, html: str, tables: list[str]) -> DataFrame:
    """(id, table_id, data_idx, readable): the label indices that a page carries, a group for each of ``tables``; a page that cannot be read has one row, not readable."""
    found = pages.select(id_, F.regexp_extract(html, LABELS, 1).alias("numbers"), F.regexp_extract(html, LABELS, 2).try_cast("int").alias("shift"))
    groups = decode_labels(F.regexp_replace("numbers", r"\s", ""), F.col("shift"))
    g = found.select(id_, F.explode(F.array(groups)).alias("groups"))  # worked out once, not for each use
    ok = F.col("groups").isNotNull() & (F.size("groups") >= len(tables)) & ~F.exists("groups", lambda x: x.isNull() | F.exists(x, lambda y: y.isNull()))

    def named(k: int, table: str) -> Column:
        return F.transform(F.get("groups", k), lambda x: F.struct(F.lit(table).alias("table_id"), x.alias("data_idx"), F.lit(True).alias("readable")))

    each = F.flatten(F.array(*(named(k, t) for k, t in enumerate(tables))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("int").alias("data_idx"), F.lit(False).alias("readable")))
    return g.select(id_, F.explode(F.when(ok, each).otherwise(none)).alias("x")).select(id_, "x.*").distinct()


def labelled_rows(pages: DataFrame, id_: str, html: str, tables: list[str], fields: dict[str, str], identity: list[str]) -> DataFrame:
    """The rows of ``tables`` with label 1 if a page's label indices name them, else 0, and ``problem``: null, or why the row, or label, cannot stand.

    Problems: LABELS_UNREADABLE (a page's label payload), NO_NUMERIC_INDEX, DUPLICATE_INDEX, MISSING_IDENTITY, LABEL_WITHOUT_ROW.
    """
    rows = table_rows(pages, id_, html, fields, tables)
    twice = F.count("data_idx").over(Window.partitionBy(id_, "table_id", "data_idx"))
    rows = rows.withColumn("twice", twice)
    labels = page_labels(pages, id_, html, tables).withColumnsRenamed({id_: "l_id", "table_id": "l_table", "data_idx": "l_idx"})
    j = rows.join(labels, (F.col(id_) == F.col("l_id")) & (F.col("table_id") == F.col("l_table")) & (F.col("data_idx") == F.col("l_idx")), "full_outer")
    lost = [F.coalesce(F.col(c), F.lit("")) == "" for c in identity]
    any_lost = lost[0]
    for x in lost[1:]:
        any_lost = any_lost | x
    problem = (
        F.when(~F.coalesce("readable", F.lit(True)), "LABELS_UNREADABLE")
        .when(F.col(id_).isNull(), "LABEL_WITHOUT_ROW")
        .when(F.col("data_idx").isNull(), "NO_NUMERIC_INDEX")
        .when(F.col("twice") > 1, "DUPLICATE_INDEX")
        .when(any_lost, "MISSING_IDENTITY")
    )
    return j.select(F.coalesce(id_, "l_id").alias(id_), F.coalesce("table_id", "l_table").alias("table_id"), "row", F.coalesce("data_idx", "l_idx").alias("data_idx"), "data_key", *fields, F.col("l_idx").isNotNull().cast("int").alias("label"), problem.alias("problem"))


def accepted(rows: DataFrame, id_: str) -> DataFrame:
    """Rows of pages without any problem: one refuses its whole page."""
    bad = rows.filter("problem IS NOT NULL").select(id_).distinct()
    return rows.join(bad, id_, "left_anti").drop("problem")


def rejected(rows: DataFrame, id_: str) -> DataFrame:
    """(id, problem, n): why pages were refused."""
    return rows.filter("problem IS NOT NULL").groupBy(id_, "problem").agg(F.count(F.lit(1)).alias("n"))


def strict(rows: DataFrame, id_: str) -> DataFrame:
    """The rows, where any problem fails the job that reads their labels."""
    said = F.concat_ws(" ", "problem", F.lit("page"), F.col(id_).cast("string"), "table_id", F.col("data_idx").cast("string"))
    return rows.withColumn("label", F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("int")).otherwise(F.col("label"))).drop("problem")
