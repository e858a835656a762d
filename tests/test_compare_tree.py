"""Comparison by hash sums finds what the plain comparison finds, and moves little."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textlens.operators import compare_tree
from textlens.operators.compare_tree import compare_by_tree, differing_ranges, range_sums, row_hashes
from textlens.operators.joins import compare_tables

COLUMNS = ["a", "b"]


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, a string, b int").withColumn("range", F.lit(1))


@pytest.mark.parametrize("bits", [2, 5, 12])
def test_same_findings(spark, monkeypatch, bits):
    monkeypatch.setattr(compare_tree, "LEVEL_BITS", bits)
    rng = random.Random(bits)
    rows = [(str(i % 180) if i % 40 else None, rng.choice(["x", "y", "", None]), rng.choice([1, 2, None])) for i in range(300)]
    other = [r for r in rows if rng.random() > 0.02] + [("new", "x", 1)]
    other = [(i, "changed" if rng.random() < 0.03 else a, b if rng.random() > 0.02 else None) for i, a, b in other]
    rng.shuffle(other)
    left, right = table(spark, rows), table(spark, other)
    want = sorted(map(str, compare_tables(left, right, "id", COLUMNS).collect()))
    assert want and sorted(map(str, compare_by_tree(left, right, "id", COLUMNS).collect())) == want


def test_swapped_nulls_and_cells_are_noticed(spark):
    left = table(spark, [("1", "x", None), ("2", None, 1), ("3", "", 1), ("3", "x", 2), (None, "x", 1)])
    for other in (
        [("1", None, None), ("2", None, 1), ("3", "", 1), ("3", "x", 2), (None, "x", 1)],
        [("1", "x", None), ("2", None, 1), ("3", None, 1), ("3", "x", 2), (None, "x", 1)],
        [("1", "x", None), ("2", None, 1), ("3", "", 2), ("3", "x", 1), (None, "x", 1)],
        [("1", "x", None), ("2", None, 1), ("3", "", 1), ("3", "x", 2), ("", "x", 1)],
        [("1", "x", None), ("2", None, 1), ("3", "", 1), ("3", "x", 2)],
    ):
        right = table(spark, other)
        want = sorted(map(str, compare_tables(left, right, "id", COLUMNS).collect()))
        assert want and sorted(map(str, compare_by_tree(left, right, "id", COLUMNS).collect())) == want


def test_equal_tables_send_sums_only(spark):
    left = spark.range(50_000).select(F.col("id").cast("string").alias("id"), F.md5(F.col("id").cast("string")).alias("a"), F.lit(1).alias("b"))
    hashes = [row_hashes(df, "id", COLUMNS) for df in (left, left.repartition(11))]
    assert range_sums(hashes[0], 1).count() == 4096  # of 50,000 rows
    assert "partial_sum" in range_sums(hashes[0], 1)._jdf.queryExecution().executedPlan().toString()
    assert differing_ranges(*hashes, 1).isEmpty()
    assert compare_by_tree(left, left.repartition(3), "id", COLUMNS).count() == 0
    one = left.withColumn("a", F.when(F.col("id") == "777", "!").otherwise(F.col("a")))
    second = differing_ranges(*[row_hashes(df, "id", COLUMNS) for df in (left, one)], 2)
    assert second.count() == 1
    (finding,) = compare_by_tree(left, one, "id", COLUMNS).collect()
    assert tuple(finding) == ("777", "a", "differs")


def test_empty_tables(spark):
    none, some = table(spark, []), table(spark, [("1", "x", 1)])
    assert compare_by_tree(none, none, "id", COLUMNS).count() == 0
    assert [r.problem for r in compare_by_tree(none, some, "id", COLUMNS).collect()] == ["right_only"]
