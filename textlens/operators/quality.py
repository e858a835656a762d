"""Data-quality checks. Each returns rows (check, expected, actual, ok) or offending rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.labels import label_is_bad
from textlens.operators.joins import (
    attach_text,
    compare_fingerprints,
    compare_tables,
    fingerprints,
    missing_text,
)


def _result(df: DataFrame, check: str, expected, actual) -> DataFrame:
    """One check row from a one-row DataFrame."""
    return df.select(
        F.lit(check).alias("check"),
        expected.cast("bigint").alias("expected"),
        actual.cast("bigint").alias("actual"),
        (expected == actual).alias("ok"),
    )


def check_row_count(left: DataFrame, right: DataFrame, name: str = "row_count") -> DataFrame:
    sides = left.select(F.lit("L").alias("_side")).unionAll(right.select(F.lit("R").alias("_side")))
    counts = sides.agg(
        F.count_if(F.col("_side") == "L").alias("_left"),
        F.count_if(F.col("_side") == "R").alias("_right"),
    )
    return _result(counts, name, F.col("_left"), F.col("_right"))


def check_expected_rows(df: DataFrame, n: int | DataFrame, name: str = "expected_rows") -> DataFrame:
    """Rows of a table against a number, or against the one value of a one-row table."""
    expected = F.lit(n) if isinstance(n, int) else n.scalar()
    return _result(df.agg(F.count("*").alias("_n")), name, expected, F.col("_n"))


def column_report(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(column, expected_at, found_at, n_values) for every column that is expected or found.

    Places count from 0 and are null where a column is missing; ``n_values`` are the rows
    with a value, counted for all columns in one pass.
    """
    names = [*expected, *[c for c in df.columns if c not in expected]]
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])

    def place(name: str, where: Sequence[str]):
        return F.lit(list(where).index(name) if name in where else None).cast("bigint")

    rows = [
        F.struct(
            F.lit(c).alias("column"),
            place(c, expected).alias("expected_at"),
            place(c, df.columns).alias("found_at"),
            (F.col(c) if c in df.columns else F.lit(None).cast("bigint")).alias("n_values"),
        )
        for c in names
    ]
    return counts.select(F.inline(F.array(*rows)))


def check_columns(df: DataFrame, expected: Sequence[str], name: str = "columns") -> DataFrame:
    """Exact ordered column list: read from the schema, no data is touched."""
    same = list(df.columns) == list(expected)
    one = df.sparkSession.range(1)
    return one.select(
        F.lit(name).alias("check"),
        F.lit(len(expected)).cast("bigint").alias("expected"),
        F.lit(len(df.columns)).cast("bigint").alias("actual"),
        F.lit(same).alias("ok"),
    )


def check_content(
    processed: DataFrame, labels: DataFrame, corpus: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Every cell of a processed split that differs from its raw source.

    Cells are hashed where they are read; the raw sources are joined as hashes. Columns
    that the labels have come from there, the others from the corpus.
    """
    of_labels = [c for c in columns if c in labels.columns]
    of_corpus = [c for c in columns if c not in labels.columns]
    raw = attach_text(
        fingerprints(labels, key, of_labels), fingerprints(corpus, key, of_corpus), key
    )
    return compare_fingerprints(fingerprints(processed, key, columns), raw, key, columns)


def check_tables_equal(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: Sequence[str],
    name: str = "tables_equal",
) -> DataFrame:
    cells = compare_tables(left, right, key, columns).agg(F.count("*").alias("_n"))
    return _result(cells, name, F.lit(0), F.col("_n"))


def check_missing(
    labels: DataFrame, corpus: DataFrame, key: str = "id", name: str = "missing_text"
) -> DataFrame:
    rows = missing_text(labels, corpus, key).agg(F.count("*").alias("_n"))
    return _result(rows, name, F.lit(0), F.col("_n"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def check_unique_key(df: DataFrame, key: str, name: str = "unique_key") -> DataFrame:
    rows = duplicate_keys(df, key).agg(F.count("*").alias("_n"))
    return _result(rows, name, F.lit(0), F.col("_n"))


def check_label_format(
    labels: DataFrame, width: int = 7, column: str = "label", name: str = "label_format"
) -> DataFrame:
    bad = labels.agg(F.count_if(label_is_bad(column, width)).alias("_n"))
    return _result(bad, name, F.lit(0), F.col("_n"))


def quality_report(*checks: DataFrame) -> DataFrame:
    """All checks as one table."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def content_check(findings: DataFrame, name: str = "content") -> DataFrame:
    """Turn a table of offending rows into a check row."""
    return _result(findings.agg(F.count("*").alias("_n")), name, F.lit(0), F.col("_n"))
