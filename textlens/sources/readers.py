"""File sources with explicit schemas.

Row position is data in some of these files (line i of the predictions belongs to row
i of the split). It is recovered from the file splits, without an RDD and without
pulling rows through Python: a split knows its file and start offset, rows of a split
are read in order, so only one count per split is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens import schemas
from textlens.functions.text import is_missing
from textlens.sources.quoted import numbered_records, quoted_records

_QUOTING = {"escape": '"'}


def _placed(scan: DataFrame) -> DataFrame:
    """Adds each row's file, the start of its split, and a number that grows with it."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _checked(index: Column, count: Column) -> Column:
    """The index of a row in its split, or an error when the file was split differently
    in the two reads (the number of cores changed in between)."""
    fits = F.coalesce((index >= 0) & (index < count), F.lit(False))
    message = F.lit("file splits changed while rows were numbered; run again")
    return F.when(fits, index).otherwise(F.raise_error(message).cast("bigint"))


# One row per file split, a hundred bytes each, is broadcast up to this many.
_MAX_BROADCAST_SPLITS = 200_000


def _per_split(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """Rows of which there is at most one per file split, broadcast when these are few.

    A file is cut into full splits, which are a task each, and one rest, so tasks plus
    files bound the splits. Beyond the limit the join is left to the optimizer.
    """
    splits = scan.rdd.getNumPartitions() + len(scan.inputFiles())
    return F.broadcast(rows) if splits <= _MAX_BROADCAST_SPLITS else rows


def number_rows(scan: DataFrame, row: str = "row_id", first: int = 0) -> DataFrame:
    """Dense row numbers of a file scan: by file name, then by position in the file.

    Joins back one row per file split; part files written in order are read in order.
    """
    placed = _placed(scan)
    splits = placed.groupBy("_file", "_start").agg(
        F.min("_seq").alias("_first_seq"), F.count("*").alias("_n")
    )
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file",
        "_start",
        "_first_seq",
        "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    index = _checked(F.col("_seq") - F.col("_first_seq"), F.col("_n"))
    joined = placed.join(_per_split(offsets, scan), ["_file", "_start"], "left")
    return joined.select((F.col("_before") + index + first).alias(row), *scan.columns)


def _null_spellings(df: DataFrame, na_values: Sequence[str]) -> DataFrame:
    if not na_values:
        return df
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(~is_missing(c, tuple(na_values)), F.col(c)) for c in strings}
    )


def _parsed_lines(
    lines: DataFrame, schema: T.StructType, options: dict[str, str], keep_corrupt: bool
) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(schemas.CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT, **options}
    rows = lines.select(F.from_csv("value", schemas.ddl(full), options).alias("_r")).select("_r.*")
    return rows if keep_corrupt else rows.drop(schemas.CORRUPT)


def _parsed_records(
    records: DataFrame, schema: T.StructType, options: dict[str, str], row_ids: bool
) -> DataFrame:
    """Records of ``quoted_records`` as rows; with ``row_ids`` their dense numbers in order of place."""
    if not row_ids:
        return _parsed_lines(records.select("value"), schema, options, False)
    parsed = F.from_csv("value", schemas.ddl(schema), {"mode": "PERMISSIVE", **options})
    return numbered_records(records).select("row_id", parsed.alias("_r")).select("row_id", "_r.*")


def read_corpus_tsv(
    spark: SparkSession,
    path: str,
    skip: int = 4,
    quote: str = '"',
    multi_line: bool = False,
    na_values: Sequence[str] = (),
    keep_corrupt: bool = False,
) -> DataFrame:
    """The raw corpus: tab-separated, no header, ``skip`` preamble lines per file.

    With ``multi_line`` quoted fields may hold line breaks; files are still read by many tasks.
    The preamble is told by its place in both cases, so rows with few fields are kept.
    """
    options = {"sep": "\t", "quote": quote, "nullValue": "", **_QUOTING}
    if multi_line:
        lines = quoted_records(spark, path, "\t", quote, skip).select("value")
        options["multiLine"] = "true"
    else:
        lines = spark.read.text(path)
        if skip:
            lines = _skip_lines(lines, skip)
    rows = _parsed_lines(lines, schemas.CORPUS, options, keep_corrupt)
    return _null_spellings(rows, na_values)


def _skip_lines(lines: DataFrame, skip: int) -> DataFrame:
    """Drop the first lines of every file, by position in the file's first split."""
    placed = _placed(lines)
    heads = (
        placed.filter(F.col("_start") == 0)
        .groupBy("_file")
        .agg(F.min("_seq").alias("_first_seq"), F.count("*").alias("_n"))
        .withColumn("_start", F.lit(0).cast("bigint"))
    )
    index = _checked(F.col("_seq") - F.col("_first_seq"), F.col("_n"))
    in_preamble = F.when(F.col("_start") == 0, index < skip).otherwise(F.lit(False))
    joined = placed.join(_per_split(heads, lines), ["_file", "_start"], "left")
    return joined.filter(~in_preamble).select("value")


def read_unlabelled_tsv(
    spark: SparkSession,
    path: str,
    quote: str = '"',
    na_values: Sequence[str] = (),
    row_ids: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """The unlabelled split: same layout, no preamble, five columns.

    ``row_ids`` adds the position that prediction files restore; ``multi_line`` is for quoted
    fields with line breaks.
    """
    if multi_line:
        options = {"sep": "\t", "quote": quote, "nullValue": "", "multiLine": "true", **_QUOTING}
        rows = _parsed_records(quoted_records(spark, path, "\t", quote), schemas.UNLABELLED, options, row_ids)
        return _null_spellings(rows, na_values)
    rows = (
        spark.read.schema(schemas.UNLABELLED)
        .options(sep="\t", quote=quote, nullValue="", **_QUOTING)
        .csv(path)
    )
    if row_ids:
        rows = number_rows(rows)
    return _null_spellings(rows, na_values)


def read_labels_csv(
    spark: SparkSession, path: str, row_ids: bool = False, na_values: Sequence[str] = ()
) -> DataFrame:
    """A label file with header; ``row_ids`` adds the position that exports restore."""
    scan = spark.read.schema(schemas.LABELS).options(header="true", **_QUOTING).csv(path)
    return _null_spellings(number_rows(scan) if row_ids else scan, na_values)


def read_split(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    labelled: bool = True,
    row_ids: bool = False,
    na_values: Sequence[str] = (),
) -> DataFrame:
    """A processed split, from Parquet or from a header CSV with quoted line breaks."""
    schema = schemas.SPLIT if labelled else schemas.UNLABELLED
    if format == "parquet":
        scan = spark.read.schema(schema).parquet(path)
    else:
        options = {"multiLine": "true", "nullValue": "", **_QUOTING}
        records = quoted_records(spark, path, ",", skip=1)
        return _null_spellings(_parsed_records(records, schema, options, row_ids), na_values)
    return _null_spellings(number_rows(scan) if row_ids else scan, na_values)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One integer per line as (row_id, pred)."""
    lines = number_rows(spark.read.text(path))
    return lines.select("row_id", F.trim("value").cast("int").alias("pred"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORES).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch metrics from JSON arrays; with ``run_id`` if ``write_history`` wrote runs."""
    read = spark.read.option("multiLine", "true")
    found = read.schema(schemas.RUNS).json(path)
    if found.inputFiles() and all("/run_id=" in f for f in found.inputFiles()):
        return found.select("run_id", *schemas.HISTORY.names)
    return read.schema(schemas.HISTORY).json(path)


def read_threshold(spark: SparkSession, path: str, default: float = 0.5) -> DataFrame:
    """The stored threshold as one row, or the default when there is no such file."""
    try:
        stored = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(F.lit(float(default)).alias("threshold"))
    value = F.max(F.trim("value").cast("double"))
    return stored.agg(F.coalesce(value, F.lit(float(default))).alias("threshold"))
