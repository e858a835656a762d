"""Sinks. Parquet is the store; CSV, JSON and text are export formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, format: str = "parquet", row: str | None = None) -> None:
    """A processed split. ``row`` restores the order of the label file and is not kept."""
    if row is not None:
        df = df.orderBy(row).drop(row)
    if "id" in df.columns:
        df = df.withColumn("id", F.col("id").cast("string"))  # the type that readers give
    if format == "parquet":
        df.write.parquet(path)
    else:
        df.write.options(header="true", escape='"', nullValue="", emptyValue="").csv(path)


def write_predictions(df: DataFrame, path: str, row: str = "row_id") -> None:
    """One 0/1 per line in row order: the sorted part files, by name, are the file."""
    df.orderBy(row).select(F.col("pred").cast("string").alias("value")).write.text(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.select(F.col("id").cast("string"), "model_id", "score").write.parquet(path)


def write_history(history: DataFrame, path: str) -> None:
    """Per-epoch metrics as JSON arrays, one a run, each in a folder ``run_id=...`` of its own.

    A run has a handful of epochs; there may be any number of runs. A history without
    ``run_id`` is one run and one array.
    """
    epochs = F.array_sort(F.collect_list(F.struct("epoch", "loss", "dev_f1", "dev_p", "dev_r")))
    if "run_id" not in history.columns:
        history.agg(F.to_json(epochs).alias("value")).write.text(path)
        return
    runs = history.groupBy("run_id").agg(F.to_json(epochs).alias("value"))
    runs.repartition("run_id").write.partitionBy("run_id").text(path)


def write_threshold(threshold: DataFrame, path: str) -> None:
    value = F.format_string("%.4f", F.col("threshold"))
    threshold.select(value.alias("value")).write.text(path)


def write_report_tables(tables: Mapping[str, DataFrame], directory: str) -> None:
    """Each table as a header CSV folder under ``directory``."""
    for name, table in tables.items():
        options = {"header": "true", "escape": '"'}
        table.write.options(**options).csv(f"{directory.rstrip('/')}/{name}")
