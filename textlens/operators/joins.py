"""Joining labels, texts, predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = ("id", "art_id", "keyword", "country", "text", "label")


def select_columns(df: DataFrame, columns: Sequence[str] = CANONICAL) -> DataFrame:
    """Those of the canonical columns that ``df`` has, in canonical order."""
    present = set(df.columns)
    return df.select(*[c for c in columns if c in present])


def missing_text(
    labels: DataFrame, corpus: DataFrame, key: str = "id", null_texts: bool = True
) -> DataFrame:
    """Label rows whose key is not in the corpus, or whose corpus text is null.

    Without ``null_texts`` only keys are compared, and the texts are not read.
    """
    texts = corpus.filter(F.col("text").isNotNull()) if null_texts else corpus
    found = texts.select(key).join(labels.select(key), key, "left_semi").distinct()
    return labels.join(found, key, "left_anti")


def attach_text(labels: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Every label row with its corpus row(s): a left join that keeps the fan-out.

    Written as an inner join plus the label rows without a match. The inner join may
    broadcast the label side when Catalyst knows it to be small, so the texts are not
    shuffled; and adaptive execution can split a hot key on either side of an inner
    join, but only on the left side of a left join. The second part reads keys only.
    """
    texts = corpus.drop(*[c for c in labels.columns if c != key and c in corpus.columns])
    matched = labels.join(texts, key, "inner")
    known = texts.select(key).join(labels.select(key), key, "left_semi").distinct()
    unmatched = labels.join(known, key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def spread(df: DataFrame, scan: DataFrame, key: str = "id") -> DataFrame:
    """Spread the rows of a scan that has fewer tasks than the session has cores.

    A small file is one or a few tasks, and tokenising would use as many cores. On
    inputs with enough splits nothing is shuffled. ``scan`` must be a plain file scan:
    counting its partitions plans it but runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, key)


def align_by_position(first: DataFrame, *others: DataFrame, row: str = "row_id") -> DataFrame:
    """Zip tables by their dense row number; a table of another length is an error.

    The check is a condition on the rows, so it holds whatever columns are read.
    """
    tagged = first.withColumn("_in_0", F.lit(True))
    for i, other in enumerate(others, start=1):
        tagged = tagged.join(other.withColumn(f"_in_{i}", F.lit(True)), row, "full_outer")
    flags = [f"_in_{i}" for i in range(len(others) + 1)]
    absent = F.lit(False)
    for flag in flags:
        absent = absent | F.col(flag).isNull()
    message = F.concat(
        F.lit("tables differ in length at row "), F.col(row).cast("string")
    )
    checked = F.when(absent, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return tagged.filter(checked).drop(*flags)


def lookup_by_key(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """The table row(s) of each wanted key: one join instead of a look-up per row."""
    return rows.join(table, key, "inner")


def labels_of_subset(subset: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """The label rows of a subset such as the missed positives."""
    return labels.join(subset.select(key), key, "left_semi")


def cast_key_as_string(df: DataFrame, *columns: str) -> DataFrame:
    """Loosely typed keys as strings, so that 7 and '7' compare equal."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _fingerprint(value: Column) -> Column:
    """128 bits of hash of a value as a string, as two numbers that can be summed.

    Null has its own fingerprint, which no string has.
    """
    digest = F.coalesce(F.sha2(value.cast("string"), 256), F.lit("null"))
    return F.struct(
        F.xxhash64(digest).cast("decimal(20,0)").alias("a"),
        F.xxhash64(F.reverse(digest)).cast("decimal(20,0)").alias("b"),
    )


def fingerprints(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The key and a fixed-size hash of each column, so that long texts need not move."""
    return df.select(key, *[_fingerprint(F.col(c)).alias(c) for c in columns])


def _whole_row(columns: Sequence[str]) -> Column:
    """One fingerprint of all cells of a row together."""
    cells = [F.concat_ws("/", F.col(c)["a"].cast("string"), F.col(c)["b"].cast("string")) for c in columns]
    return _fingerprint(F.concat_ws("|", *cells))


def compare_fingerprints(
    left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """``compare_tables`` on tables of fingerprints; a null one stands for a null value."""
    absent = _fingerprint(F.lit(None))
    sides = [
        side.select(
            key, F.lit(name).alias("_side"), *[F.coalesce(F.col(c), absent).alias(c) for c in columns]
        )
        for side, name in ((left, "L"), (right, "R"))
    ]
    sides = [side.withColumn("_row", _whole_row(columns)) for side in sides]
    sums = []
    for c in [*columns, "_row"]:
        for part in ("a", "b"):
            signed = F.when(F.col("_side") == "L", F.col(c)[part]).otherwise(-F.col(c)[part])
            sums.append(F.sum(signed).alias(f"_{c}_{part}"))
    grouped = (
        sides[0]
        .unionByName(sides[1])
        .groupBy(key)
        .agg(
            F.count_if(F.col("_side") == "L").alias("_n_left"),
            F.count_if(F.col("_side") == "R").alias("_n_right"),
            *sums,
        )
    )

    def finding(name, problem):
        return F.struct(
            F.lit(name).cast("string").alias("column_name"), F.lit(problem).alias("problem")
        )

    cells = [
        F.when((F.col(f"_{c}_a") != 0) | (F.col(f"_{c}_b") != 0), finding(c, "differs"))
        for c in columns
    ]
    findings = (
        F.when(F.col("_n_right") == 0, F.array(finding(None, "left_only")))
        .when(F.col("_n_left") == 0, F.array(finding(None, "right_only")))
        .when(F.col("_n_left") != F.col("_n_right"), F.array(finding(None, "row_count")))
        .when(
            F.coalesce(*[c["problem"] for c in cells]).isNull() & ((F.col("__row_a") != 0) | (F.col("__row_b") != 0)),
            F.array(finding(None, "row")),
        )
        .otherwise(F.filter(F.array(*cells), lambda f: f.isNotNull()))
    )
    return grouped.select(key, F.inline(findings))


def compare_tables(
    left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """One row (key, column_name, problem) per cell that differs; null equals null.

    Compared as strings. Both sides go through one grouping by key of fixed-size
    hashes, so long texts are never shuffled and a key repeated on both sides is
    summed, not multiplied. Rows of a repeated key are compared as a bag. A key found
    on one side only is reported once, with a null column name; so are rows of a repeated
    key whose cells are the same but belong together differently (problem "row").
    """
    return compare_fingerprints(
        fingerprints(left, key, columns), fingerprints(right, key, columns), key, columns
    )


def class_contrast_join(counts: DataFrame, term: str, n: str = "n", y: str = "y") -> DataFrame:
    """Per-class counts of one term side by side, 0 where a class lacks the term."""
    return counts.groupBy(term).agg(
        F.coalesce(F.sum(F.when(F.col(y) == 1, F.col(n))), F.lit(0)).alias(f"{n}_pos"),
        F.coalesce(F.sum(F.when(F.col(y) == 0, F.col(n))), F.lit(0)).alias(f"{n}_neg"),
    )
