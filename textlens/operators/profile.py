"""Profile of a labelled collection: classes, labels, lengths, vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.labels import labels_per_row
from textlens.functions.scoring import percent_of, safe_ratio
from textlens.operators.lexical import explode_ngrams


def split_by_class(examples: DataFrame, y: int) -> DataFrame:
    """Rows of one class. Operators here keep ``y`` as a grouping column instead."""
    return examples.filter(F.col("y") == y)


def class_distribution(examples: DataFrame) -> DataFrame:
    """Rows and percent per class, the total, and negatives per positive: one row."""
    counts = examples.agg(
        F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if(F.col("y") == 0).alias("n_neg"),
        F.count("*").alias("n_total"),
    )
    return counts.select(
        "n_pos",
        "n_neg",
        "n_total",
        percent_of("n_pos", "n_total").alias("pct_pos"),
        percent_of("n_neg", "n_total").alias("pct_neg"),
        safe_ratio("n_neg", "n_pos").alias("imbalance_ratio"),
    )


def label_frequency(examples: DataFrame, vector: str = "label_vec") -> DataFrame:
    """Rows and percent of all rows per label position."""
    positions = examples.select(F.posexplode(vector).alias("label_ix", "value"))
    per_label = positions.groupBy("label_ix").agg(
        F.sum("value").cast("bigint").alias("n"), F.count("*").alias("_rows")
    )
    return per_label.select("label_ix", "n", percent_of("n", "_rows").alias("pct"))


def labels_per_row_histogram(examples: DataFrame, vector: str = "label_vec") -> DataFrame:
    return examples.groupBy(labels_per_row(vector).cast("bigint").alias("n_labels")).agg(
        F.count("*").alias("n_rows")
    )


def labels_per_row_stats(examples: DataFrame, vector: str = "label_vec") -> DataFrame:
    """Labels per row, and rows with one or several labels.

    Several-label rows are given as a share of all rows and of the positive rows.
    """
    per_row = examples.select(labels_per_row(vector).alias("_k"))
    stats = per_row.agg(
        F.avg("_k").alias("mean_labels"),
        F.min("_k").cast("bigint").alias("min_labels"),
        F.max("_k").cast("bigint").alias("max_labels"),
        F.count_if(F.col("_k") == 1).alias("n_single"),
        F.count_if(F.col("_k") > 1).alias("n_multi"),
        F.count_if(F.col("_k") > 0).alias("_n_pos"),
        F.count("*").alias("_n"),
    )
    return stats.select(
        "mean_labels",
        "min_labels",
        "max_labels",
        "n_single",
        percent_of("n_single", "_n").alias("pct_single"),
        "n_multi",
        percent_of("n_multi", "_n").alias("pct_multi"),
        percent_of("n_multi", "_n_pos").alias("pct_multi_of_pos"),
    )


def length_frequencies(tokens: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Rows per token count: the one pass over the texts behind every length figure.

    It has at most one row per distinct length, so what follows is small.
    """
    return tokens.groupBy(F.col(length).cast("bigint").alias("length")).agg(
        F.count("*").alias("n")
    )


def token_length_stats(
    tokens: DataFrame, length: str = "n_tokens", approximate: bool = False
) -> DataFrame:
    """Mean, median, range and sample standard deviation of the token counts.

    The exact median keeps one counter per distinct length in a task. The approximate one
    is an actual length whose rank is within one in 10,000 of the middle.
    """
    median = F.percentile_approx(length, 0.5, 10_000) if approximate else F.median(length)
    return tokens.agg(
        F.avg(length).alias("mean_tokens"),
        median.cast("double").alias("median_tokens"),
        F.min(length).cast("bigint").alias("min_tokens"),
        F.max(length).cast("bigint").alias("max_tokens"),
        F.stddev_samp(length).alias("std_tokens"),
    )


def vocabulary(tokens: DataFrame) -> DataFrame:
    return explode_ngrams(tokens, 1, ()).groupBy("term").agg(F.count("*").alias("n"))


def vocabulary_size(tokens: DataFrame, approximate: bool = False) -> DataFrame:
    terms = explode_ngrams(tokens, 1, ())
    count = F.approx_count_distinct("term") if approximate else F.count_distinct("term")
    return terms.agg(count.alias("vocabulary_size"))


def _bin(value, low, high, bins: int):
    """0-based equal-width bin; the last bin includes the maximum."""
    width = (high - low).cast("double")
    at = F.floor(safe_ratio((value - low) * F.lit(float(bins)), width))
    return F.least(at, F.lit(bins - 1).cast("bigint"))


def length_histogram(tokens: DataFrame, bins: int = 50, length: str = "n_tokens") -> DataFrame:
    """Equal-width histogram over the data's own range, empty bins included."""
    frequencies = length_frequencies(tokens, length)
    # One row per distinct length: the unpartitioned window is over a small table.
    everything = Window.partitionBy()
    ranged = frequencies.select(
        "length",
        "n",
        F.min("length").over(everything).alias("low"),
        F.max("length").over(everything).alias("high"),
    )
    # A null length is in no bin.
    counted = ranged.filter(F.col("length").isNotNull()).groupBy(
        _bin(F.col("length"), F.col("low"), F.col("high"), bins).alias("bin"), "low", "high"
    ).agg(F.sum("n").alias("n"))
    # At most ``bins`` entries in one row, from which the empty bins are filled in.
    filled = counted.groupBy("low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n")
    )
    numbers = F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return filled.select("low", "high", "_n", F.explode(numbers).alias("bin")).select(
        "bin",
        (F.col("low") + F.col("bin") * step).alias("bin_low"),
        (F.col("low") + (F.col("bin") + 1) * step).alias("bin_high"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).alias("n"),
    )


def length_coverage(
    tokens: DataFrame, limits: Sequence[int] = (128, 256), length: str = "n_tokens"
) -> DataFrame:
    """Rows within each length limit; decides where texts would be cut."""
    frequencies = length_frequencies(tokens, length)
    limit = F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits])).alias("max_tokens")
    return (
        frequencies.select("length", "n", limit)
        .groupBy("max_tokens")
        .agg(
            F.coalesce(
                F.sum(F.when(F.col("length") <= F.col("max_tokens"), F.col("n"))), F.lit(0)
            ).alias("n_within"),
            F.sum("n").alias("n_total"),
        )
        .withColumn("share", safe_ratio("n_within", "n_total"))
    )
