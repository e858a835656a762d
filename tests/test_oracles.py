"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from textlens.plans import ORACLES, QUERIES
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
SQL = ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    problems = differences(QUERIES[name](spark, SF_DIR), duck, SQL[name])
    assert not [p for p in problems if "within rounding" not in p]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() == 8


def test_comparison_notices_differences(spark, duck):
    df = spark.sql("SELECT 1L AS a, 'x' AS b")
    assert differences(df, duck, "SELECT 1::BIGINT AS a, 'x' AS b") == []
    assert differences(df, duck, "SELECT 2::BIGINT AS a, 'x' AS b")
    assert differences(df, duck, "SELECT 1::INTEGER AS a, 'x' AS b")
    assert differences(df, duck, "SELECT 1::BIGINT AS c, 'x' AS b")
    assert differences(df, duck, "SELECT 1::BIGINT AS a, 'x' AS b UNION ALL SELECT 1, 'x'")
