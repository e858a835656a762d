"""Cases of missing scores, uneven tables, swapped cells and odd grids."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from textlens.functions.scoring import decide
from textlens.operators import joins, metrics, quality


def test_swapped_cells_of_a_repeated_key_are_found(spark):
    names = "id long, a string, b string"
    left = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z")], names)
    right = spark.createDataFrame([(1, "a", "y"), (1, "b", "x"), (2, "c", "z")], names)
    found = joins.compare_tables(left, right, "id", ["a", "b"]).collect()
    assert [(r.id, r.column_name, r.problem) for r in found] == [(1, None, "row")]
    assert not quality.check_tables_equal(left, right, "id", ["a", "b"]).first().ok
    assert joins.compare_tables(left, left, "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("read", [lambda d: d.select("y", "pred"), lambda d: d.agg(F.sum("y")), lambda d: d.groupBy("y").count()])
def test_uneven_tables_are_an_error_whatever_is_read(spark, read):
    five = spark.range(5).select(F.col("id").alias("row_id"), F.lit(1).alias("y"))
    three = spark.range(3).select(F.col("id").alias("row_id"), F.lit(0).alias("pred"))
    with pytest.raises(Exception, match="differ in length"):
        read(joins.align_by_position(five, three)).collect()
    assert len(read(joins.align_by_position(five, five.withColumnRenamed("y", "pred"))).collect()) >= 1


@pytest.mark.parametrize("lo, hi, step", [(0.05, 0.95, 0.03), (0.05, 0.95, 0.1), (0.0, 1.0, 0.005), (0.123, 0.5, 0.07), (0.05, 0.95, 0.01)])
def test_grid_is_the_one_asked_for(spark, lo, hi, step):
    scores = [None, math.nan, 0.0, 0.08, 0.123, 0.193, 0.29, 0.35, 0.95, 1.0, 0.05, 0.15]
    df = spark.createDataFrame([(s, i % 2) for i, s in enumerate(scores)], "score double, y int")
    points, i = [], 0
    while round(lo + i * step, 9) <= hi:
        points.append(round(lo + i * step, 9))
        i += 1
    got = metrics.threshold_grid(df, lo, hi, step).orderBy("threshold").collect()
    assert [r.threshold for r in got] == points
    kept = [(s, i % 2) for i, s in enumerate(scores) if s is not None and not math.isnan(s)]
    for r in got:
        tp = sum(y for s, y in kept if s >= r.threshold)
        n = sum(s >= r.threshold for s, _ in kept)
        assert r.precision == pytest.approx(tp / n if n else 0)


def test_missing_scores_are_left_out_everywhere(spark):
    rows = [(1, 0.9, "g"), (0, 0.1, "g"), (1, None, "g"), (1, math.nan, "g")]
    df = spark.createDataFrame(rows, "y int, score double, keyword string").withColumn("pred", decide("score", 0.5))
    assert [r.pred for r in df.orderBy(F.col("score").asc_nulls_first()).collect()] == [None, 0, 1, None]
    assert metrics.binary_metrics(df).first().recall == 1.0
    group = metrics.errors_by_group(df).first()
    assert (group.n_total, group.n_pos, group.recall) == (2, 1, 1.0)
    assert metrics.predicted_positives(df).first().n_total == 2
    assert metrics.average_precision(df).first()[0] == 1.0
    assert metrics.pr_curve(df).count() == 3
