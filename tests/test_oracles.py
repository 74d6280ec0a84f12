"""Every registered query with a DuckDB equivalent gives the same rows at sf0.001; the others are tested in test_models.py."""

from __future__ import annotations

import pytest

from oddsloom.plans import registry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0 and df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
