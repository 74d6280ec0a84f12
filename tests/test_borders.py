"""Values that lie on a border lie on one side of it, whatever the order of a sum."""

from __future__ import annotations

import datetime
import itertools

import pytest

from oddsloom.plans import registry

QUERIES = registry.queries()
PRICES = "l_orderkey long, l_suppkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"


@pytest.fixture
def tables(spark, tmp_path):
    def write(lines):
        """One match with quotes of (book, price of a home win in tenths)."""
        day = datetime.datetime(1996, 1, 1)
        rows = [(1, book, k, k, float(tenths - 12), 0.0, "A", day) for k, (book, tenths) in enumerate(lines)]
        spark.createDataFrame(rows, PRICES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.createDataFrame([(1, 7, "1-URGENT", day)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("order", list(itertools.permutations((14, 17, 44))))
def test_a_mean_price_of_two_and_a_half_is_in_the_fifth_bin(spark, tables, order):
    row = QUERIES["a14_calibration_bins"](spark, tables([(0, x) for x in order])).first()
    assert (row.bin, row.mean_p) == (4, 0.4)


def test_a_gap_of_exactly_a_limit_has_the_higher_grade(spark, tables):
    d = tables([(0, 40)] + [(3 + k // 5, 25) for k in range(6)])
    row = QUERIES["a22_cluster_divergence"](spark, d).first()
    assert abs(row.pp) == pytest.approx(15) and row.grade == "A"
