"""Pages that grow with the table: tasks hold one, or a few, at a time, from their building to their folding."""

from __future__ import annotations

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from oddsloom.plans import ingest
from oddsloom.sources import pages


def test_pages_are_built_one_at_a_time(spark):
    plan = ingest._pool_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    rows = [("d1", "bdtbl", 0, "<b>", True), ("d1", "tbl", 0, "<c>", False), ("d1", "tbl", 1, None, True), ("d2", "tbl", 0, "<d>", False), (None, "tbl", 0, "<e>", None)]
    read = []

    def batches():
        for x in rows:
            read.append(x[0])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()))], ["day", "table_id", "idx", "tr", "draw"])

    made = ingest._day_pages(batches())
    first = next(made).to_pylist()[0]
    assert first["day"] == "d1" and read == ["d1", "d1", "d1", "d2"]
    codes = [int(x) for x in first["html"].split("[")[1].split("]")[0].split(",")]
    assert "".join(chr(x - 13) for x in codes) == "[[1],[0]]" and "<tbody><c></tbody>" in first["html"] and "<tbody><b></tbody>" in first["html"]
    assert [x.to_pylist()[0]["day"] for x in made] == ["d2", None]
    assert list(ingest._day_pages(iter(()))) == []


def test_long_rows_are_read_back_in_small_groups(spark):
    long = spark.range(0, 60, 1, 1).select(F.expr("array_join(transform(sequence(1, 16000), x -> sha2(concat(id, '-', x), 256)), '')").alias("html"))
    back = ingest._once(long, "long-rows", ingest._LONG_ROWS)
    files = [pq.ParquetFile(x).metadata for x in glob.glob(back.inputFiles()[0].removeprefix("file://"))]
    assert sum(x.num_rows for x in files) == 60 and max(x.row_group(k).num_rows for x in files for k in range(x.num_row_groups)) <= 6
    assert back.select(F.sum(F.length("html"))).first()[0] == 60 * 16_000 * 64


def test_rows_equal_their_cells_and_leave_the_fold_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(pages, "CELLS", 7)
    r = random.Random(3)
    bits = ['<table id="a">', "<table id='b'>", "<table>", "</table>", "<tbody>", "</tbody>", "<tr>", '<tr data-idx="1" data-key=k>', "<tr data-idx='x'>", '<td class="p q">', "<td class=q>", "<th class='p'>", "</td>", "x", " y&amp;z ", '<b class="rq-badge">', "</b>"]
    html = [(k, '<table id="a"><tbody>' + "".join(r.choices(bits, [1] * 6 + [9] * 11, k=60))) for k in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(html, "page int, html string").repartition(3)
    fields = {"f": "p", "g": "q"}
    cells = pages.table_cells(df, "page", "html").filter("table_id IN ('a', 'b')")
    has = lambda c: F.array_contains(F.split("cell_class", r"\s+"), c)
    key = [pages.attribute(F.col("row_tag"), "data-idx").try_cast("int").alias("data_idx"), F.coalesce(pages.attribute(F.col("row_tag"), "data-key"), F.lit("")).alias("data_key")]
    want = cells.groupBy("page", "table_id", "row", *key).agg(*(F.max(F.when(has(c), F.col("text"))).alias(n) for n, c in fields.items()))
    got = pages.table_rows(df, "page", "html", fields, ["a", "b"])
    as_text = lambda x: sorted(map(str, x.collect()))
    assert as_text(got) == as_text(want) and got.count() > 300
    plan = pages.table_rows(df, "page", "html", fields, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
