"""Every registered query with an oracle equals DuckDB on the smallest scale."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = os.environ.get("SECSCAN_TEST_SF", "/root/testdata/sf0.001")
ORACLES = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "score" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    sp = E.queries()[name](spark, SF).toPandas()
    ok, msg = compare(sp, duck(ORACLES[name], SF))
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() > 0
