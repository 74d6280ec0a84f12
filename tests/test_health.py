"""Every check and both thresholds of batch health on small fixtures."""

from __future__ import annotations

import datetime

import pytest

from oddsloom.operators import health

SCHEMA = "batch date, match_id long, book_id int, market string, ts timestamp, seq int, row_no long, line int, prices struct<h:double,d:double>, impossible boolean, over double, devig_sum double, conflict boolean, core boolean, foreign_row boolean, no_time boolean"


def quote(match=1, book=0, market="1x2", hour=0, seq=1, price=2.0, month=1, **flags):
    known = {"impossible": False, "over": 0.05, "devig_sum": 1.0, "conflict": False, "core": book < 3, "foreign_row": False, "no_time": False} | flags
    return (datetime.date(2024, month, 1), match, book, market, datetime.datetime(2024, month, 1, hour), seq, seq, 0, (price, 3.0), *known.values())


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([quote()], set()),
        ([quote(impossible=True), quote(seq=2, hour=1, impossible=True)], {("IMPOSSIBLE_ODDS_OR_LINE", "WARN", 2)}),
        ([quote(devig_sum=1.0 + 2e-9)], {("DEVIG_SUM_INVALID", "FAIL", 1)}),
        ([quote(over=0.26), quote(market="ah", over=0.9)], {("EXTREME_OVERROUND", "WARN", 1)}),
        ([quote(book=5, conflict=True)], {("BOOKMAKER_IDENTITY_CONFLICT", "WARN", 1)}),
        ([quote(book=5, conflict=True), quote(book=1, conflict=True)], {("CORE_BOOKMAKER_IDENTITY_CONFLICT", "FAIL", 2)}),
        ([quote(foreign_row=True)], {("CROSS_MATCH_CONTAMINATION", "FAIL", 1)}),
        ([quote(), quote(seq=2, price=2.5), quote(seq=3)], {("CONFLICTING_DUPLICATE", "WARN", 1)}),
        ([quote(hour=5), quote(seq=2, hour=4)], {("TIMELINE_SOURCE_REVERSE_ORDER", "WARN", 1)}),
    ],
)
def test_each_semantic_check(spark, rows, want):
    got = health.semantic_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.code, r.severity, r.n) for r in got} == want


def month_of(month, matches=10, books=(0, 1), each=4, **flags):
    return [quote(match=m, book=b, month=month, seq=k + 1, hour=k, **flags) for m in range(matches) for b in books for k in range(each)]


def events(spark, rows):
    return {(r.batch.month, r.code, r.severity, r.what) for r in health.batch_events(spark.createDataFrame(rows, SCHEMA)).collect()} - {(1, "HISTORICAL_BASELINE_UNAVAILABLE", "INFO", None)}


def test_rates_and_drops_of_batches(spark):
    calm = month_of(1) + month_of(2)
    assert events(spark, calm) == set()
    assert events(spark, calm + month_of(3, each=2)) == {(3, "STRUCTURAL_DEGRADATION_ALERT", "WARN", None)}
    assert events(spark, calm + month_of(3, each=1)) == {(3, "STRUCTURAL_DEGRADATION_ALERT", "FAIL", None)}
    thin = [r for r in month_of(3) if r[2] == 0 or r[1] < 7]
    assert events(spark, calm + thin) == {(3, "COVERAGE_DROP_ALERT", "WARN", "1x2:1")}
    assert (3, "COVERAGE_DROP_ALERT", "FAIL", "1x2:1") in events(spark, calm + [r for r in month_of(3) if r[2] == 0 or r[1] < 2])
    untimed = lambda share: [quote(match=r[1], book=r[2], month=3, seq=r[5], hour=r[4].hour, no_time=k < share * 80) for k, r in enumerate(month_of(3))]
    assert events(spark, calm + untimed(0.3)) == {(3, "MISSING_TIMESTAMPS_HIGH", "WARN", None)}
    assert events(spark, calm + untimed(0.8)) == {(3, "TIMESTAMP_FORMAT_OR_PARSE_FAILURE", "FAIL", None)}
    assert events(spark, calm + month_of(3, impossible=True)) == {(3, "IMPOSSIBLE_ODDS_WIDESPREAD", "FAIL", None)}
    doubled = month_of(3) + [quote(match=m, month=3, hour=0, seq=9, price=9.0) for m in range(5)]
    assert events(spark, calm + doubled) >= {(3, "CONFLICTING_DUPLICATES_WIDESPREAD", "FAIL", None)}
