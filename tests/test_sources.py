"""Page tables, declared scans and published batches, and how each refuses what is wrong."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from oddsloom.sources import commits, declared, pages

FIELDS = {"no": "c-no", "league": "c-league", "teams": "c-team", "time": "c-time"}
IDENTITY = list(FIELDS)


def row(i, teams="A &amp; B vs C", extra="", time="2024-01-01 20:00"):
    idx = "" if i is None else f' data-idx="{i}"'
    return f'<tr{idx} data-key="k{i}"><td class="c-no x">{i}</td><td class="c-league"><b>Le</b>ague</td><td class="c-team"><span class="rq-badge">hot</span> {teams} {extra}</td><td class="c-time">{time}</td></tr>'


def page(rows, labels, more=""):
    code = ",".join(str(ord(c) + 7) for c in str(labels))
    return f'<html><script>var _mk=[{code}].map(function(c){{return String.fromCharCode(c-7);}}).join("");var s="<table>";</script><!-- <table id="tbl"> --><table id="tbl"><thead><tr><th>no</th></tr></thead><tbody>{"".join(rows)}</tbody></table><table id="bdtbl"><tbody>{more}</tbody></table></html>'


def read(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    return pages.labelled_rows(df, "page_id", "html", ["tbl", "bdtbl"], FIELDS, IDENTITY)


def test_one_row_per_body_row_with_its_label(spark):
    nested = "<table><tbody><tr><td>in</td></tr></tbody></table>"
    html = page([row(0), row(3, extra=nested), row(5)], [[3, 5], [1], [99]], row(1))
    got = {(r.table_id, r.data_idx): r for r in pages.accepted(read(spark, html), "page_id").collect()}
    assert {k: r.label for k, r in got.items()} == {("tbl", 0): 0, ("tbl", 3): 1, ("tbl", 5): 1, ("bdtbl", 1): 1}
    first = got["tbl", 0]
    assert (first.no, first.league, first.teams, first.time, first.data_key, first.row) == ("0", "Le ague", "A & B vs C", "2024-01-01 20:00", "k0", 0)
    assert got["tbl", 3].teams == "A & B vs C in"


@pytest.mark.parametrize(
    ("html", "problem"),
    [
        (page([row(1), row(1)], [[], []]), "DUPLICATE_INDEX"),
        (page([row(1, time="")], [[], []]), "MISSING_IDENTITY"),
        (page([row(1)], [[2], []]), "LABEL_WITHOUT_ROW"),
        (page([row(None)], [[], []]), "NO_NUMERIC_INDEX"),
        (page([row(1)], [[1, "x"], []]), "LABELS_UNREADABLE"),
        (page([row(1)], [[1]]), "LABELS_UNREADABLE"),
    ],
)
def test_a_wrong_page_is_refused_as_a_whole(spark, html, problem):
    rows = read(spark, html, page([row(0)], [[0], []]))
    assert {r.page_id for r in pages.accepted(rows, "page_id").collect()} == {1}
    assert {(r.page_id, r.problem) for r in pages.rejected(rows, "page_id").collect()} == {(0, problem)}
    with pytest.raises(Exception, match=problem):
        pages.strict(rows, "page_id").collect()


def test_a_declared_scan_fails_on_wrong_counts(spark, tmp_path):
    spark.range(7).withColumnRenamed("id", "a").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = declared.scan(spark, f"{tmp_path}/in", "t")
    manifest = lambda n, t="t": spark.createDataFrame([(t, n)], "table string, rows long")
    out = declared.stage(spark, {"t": rows}, manifest(7), f"{tmp_path}/ok")["t"].collect()
    assert len(out) == 7 and all(r.source_table == "t" and r.source_file.endswith(".parquet") and r.source_position == 0 for r in out)
    for wrong in (manifest(8), manifest(7, "u")):
        with pytest.raises(declared.DeclaredCountError):
            declared.stage(spark, {"t": rows}, wrong, f"{tmp_path}/bad")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        spark.range(2).select(F.col("id").alias("a"), F.col("id").alias("A")).write.parquet(f"{tmp_path}/twice")
        with pytest.raises(declared.DuplicateColumnError):
            declared.scan(spark, f"{tmp_path}/twice", "t")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_the_log_moves_forward_only(spark, tmp_path):
    log = commits.BatchLog(spark, f"file://{tmp_path}/log-a")
    one = lambda k: spark.createDataFrame([(k,)], "x int")
    assert log.publish(one(1), "2024-01-02", "aa", 10) == "PUBLISHED"
    assert log.publish(one(1), "2024-01-02", "aa", 11) == "NO_CHANGES"
    assert log.publish(one(2), "2024-01-02", "bb", 12) == "REVISED"
    assert log.publish(one(3), "2024-01-02", "cc", 9) == "STALE_SOURCE"
    assert log.publish(one(4), "2024-01-01", "dd", 99) == "STALE_SOURCE"
    assert log.publish(one(5), "2024-01-03", "ee", 13, status="FAIL") == "QUARANTINED"
    assert log.latest()["content_hash"] == "bb" and log.revisions("2024-01-02") == ["aa"]
    assert [r.x for r in log.current().collect()] == [2]


def test_of_two_writers_one_wins(spark, tmp_path):
    log = commits.BatchLog(spark, f"file://{tmp_path}/log-b")
    record = {"batch_date": "2024-01-01", "crawler_ts": 1, "status": "PASS", "folder": "x"}
    won, start = [], threading.Barrier(2)

    def run(k):
        start.wait()
        won.append(log.commit(0, record | {"content_hash": k}))

    both = [threading.Thread(target=run, args=(k,)) for k in "ab"]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(won) == [False, True] and len(log.records()) == 1
    assert log.commit(0, record | {"content_hash": "c"}) is False and log.commit(1, record | {"content_hash": "c"}) is True


def test_pages_are_folded_where_they_are_read(spark):
    """Cells need no shuffle and no sort of tags, whatever a page's length; odd tags, badges, comments and nested tables keep their sense."""
    html = '<table id="tbl"><tbody><tr data-idx=0><td class="a">x<!-- <td> --><b class="rq-badge">no</b> y<table><tbody><tr><td>z</td></tr></tbody></table><td title="p<q">' + "w " * 50_000 + "</tbody></table><table><tbody><tr><td>none</table>"
    cells = pages.table_cells(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string"), "page_id", "html")
    assert [(r.row, r.cell, r.cell_class, r.text) for r in cells.orderBy("cell").collect()] == [(0, 0, "a", "x y z"), (0, 1, "", " ".join(["w"] * 50_000))]
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
