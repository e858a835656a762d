"""Comparison of tables by a tree of hash sums: what is equal is never shuffled.

Keys fall into ranges by their hash, and each range has the number of its rows and sums of their
hashes, which tasks add up before anything moves. Only ranges whose sums differ are looked
at more closely, in ranges of their own, and only rows of the last ranges that still differ
are compared cell by cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.operators.joins import compare_tables
from textlens.session import stored

#: Bits of the key's hash that each level of the tree looks at: 4096 ranges a range.
LEVEL_BITS = 12
LEVELS = 2
_SUMS = ("n", "a", "b", "c", "d")


def key_range(key: str) -> Column:
    """64 bits of hash of a key, null included, by which keys fall into ranges."""
    return F.xxhash64(F.lit("range"), F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit("")))


def row_hashes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(range, row_a, row_b): the hash of the key, and 128 bits of all cells and their nulls."""
    cells = []
    for c in (key, *columns):
        cells += [F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return df.select(
        key_range(key).alias("range"),
        F.xxhash64(*cells).alias("row_a"),
        F.xxhash64(F.lit("second"), *cells).alias("row_b"),
    )


def _prefix(level: int):
    """The first bits of the range, as a number: a range of this level of the tree."""
    return F.shiftrightunsigned("range", 64 - LEVEL_BITS * level)


def range_sums(hashes: DataFrame, level: int) -> DataFrame:
    """(prefix, n, a, b, c, d) of every range: rows, and sums of the halves of their hashes, which
    cannot overflow below two thousand million rows in a range."""
    halves = {"a": ("row_a", 0), "b": ("row_a", 32), "c": ("row_b", 0), "d": ("row_b", 32)}
    sums = [
        F.sum(F.shiftrightunsigned(F.col(c), shift).bitwiseAND(F.lit(0xFFFFFFFF))).alias(name)
        for name, (c, shift) in halves.items()
    ]
    return hashes.groupBy(_prefix(level).alias("prefix")).agg(F.count("*").alias("n"), *sums)


def differing_ranges(left: DataFrame, right: DataFrame, level: int) -> DataFrame:
    """The ranges of a level whose rows are not the same on both sides, as stored (prefix)."""
    signed = range_sums(left, level).unionByName(
        range_sums(right, level).select("prefix", *[(-F.col(c)).alias(c) for c in _SUMS])
    )
    totals = signed.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in _SUMS])
    apart = F.lit(False)
    for c in _SUMS:
        apart = apart | (F.col(c) != 0)
    return stored(totals.where(apart).select("prefix"), "ranges")


def _inside(rows: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    """The rows in ranges of a level; Spark broadcasts the ranges if their stored size allows it."""
    return rows.withColumn("_prefix", _prefix(level)).join(
        ranges.withColumnRenamed("prefix", "_prefix"), "_prefix", "left_semi"
    ).drop("_prefix")


def compare_by_tree(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The findings of ``compare_tables``: one row (key, column_name, problem) per cell that differs.

    For tables that are nearly the same: both are hashed once, to 24 bytes a row, and of equal
    tables each task sends the sums of 4096 ranges. Rows are shuffled only from
    ranges of 2**-24 of the keys that differ. Tables that differ in most of their keys are
    cheaper to compare with ``compare_tables``. Nulls, repeated keys and extra columns
    count as they do there.
    """
    sides = [stored(row_hashes(df, key, columns), "row-hashes") for df in (left, right)]
    ranges, level = differing_ranges(*sides, 1), 1
    while level < LEVELS and not ranges.isEmpty():
        level += 1
        ranges = differing_ranges(*[_inside(side, ranges, level - 1) for side in sides], level)

    def suspects(df: DataFrame) -> DataFrame:
        rows = df.select(key, *columns, key_range(key).alias("range"))
        return _inside(rows, ranges, level).drop("range")

    return compare_tables(suspects(left), suspects(right), key, columns)
