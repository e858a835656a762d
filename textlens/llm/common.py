"""Shared pieces of the operators: stored intermediate tables, words, row fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read, and gives the optimizer the
    table's true size, so that it broadcasts only what is small.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fingerprint(*columns: Column) -> list[Column]:
    """128 bits of hash as two columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that models must not learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def uniform(*columns: Column) -> Column:
    """A repeatable number in [0, 1) from a hash of the columns."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
