"""Ranking at scale: top-k per class, prefix sums, ordinals and exact medians.

A window over a class flag or over nothing sends all rows to one task. The helpers
here never do that: top-k prunes to k rows per task before the shuffle, and prefix
sums run inside value buckets whose sizes are balanced by approximate quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import settle

_BUCKET = "_bucket"
_SORT_VALUE = "_bucket_value"

# Rows that one task of a prefix sum sorts, about.
_BUCKET_ROWS = 1_000_000


def top_k(
    df: DataFrame,
    k: int,
    by: Sequence[str],
    order: Sequence,
    rank: str = "rank",
) -> DataFrame:
    """The first k rows per group under a total order, with their rank.

    For ``row_number() <= k`` Spark plans a partial group limit below the shuffle, so
    each task sends at most k rows per group. Beyond the limit up to which Spark does
    so (``spark.sql.optimizer.windowGroupLimitThreshold``), a salted first round keeps
    any single task from seeing a whole group.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        slots = _slots(df)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(slots)))
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_first", F.row_number().over(first))
            .filter(F.col("_first") <= k)
            .drop("_first", "_salt")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, k: int, order: Sequence) -> DataFrame:
    """The first k rows under a total order: each task keeps k rows, one merges them.

    Stated as a rank, not as a limit, because a projection that the optimizer moves
    between a limit and its sort turns the pair into a full sort.
    """
    return top_k(df, k, [], order, "_rank").drop("_rank")


def _slots(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add a bucket number that grows with ``key``; buckets hold similar row counts.

    The inner bounds are at most ``buckets`` doubles. They become literals of the plan,
    so a recomputed task puts every row in the same bucket again.
    """
    valued = df.withColumn(_SORT_VALUE, F.col(key).cast("double"))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = valued.approxQuantile(_SORT_VALUE, shares, 1.0 / (2 * buckets)) if shares else []
    inner = sorted(set(bounds))
    if not inner:
        return valued.withColumn(_BUCKET, F.lit(0.0)).drop(_SORT_VALUE)
    splits = [float("-inf"), *inner, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=_SORT_VALUE, outputCol=_BUCKET)
    return bucketizer.transform(valued).drop(_SORT_VALUE)


def prefix_sums(
    df: DataFrame,
    key: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Running totals ``cum_<v>`` in ``key`` order, plus ``total_<v>``, per ``by`` group.

    ``df`` holds one row per (by, key), with a numeric key that is never null. ``by``
    must be a flag with few values: the bucket totals, at most ``buckets`` rows per
    group, are broadcast; there is one for each million rows. ``df`` is read four times, so give a stored or settled one.
    """
    # A few buckets per task even out the hashing of buckets to tasks.
    buckets = buckets or max(4 * _slots(df), -(-df.count() // _BUCKET_ROWS))
    by = list(by)
    bucketed = _bucketed(df, key, buckets)

    per_bucket = bucketed.groupBy(*by, _BUCKET).agg(
        *[F.sum(v).alias(f"_sum_{v}") for v in values]
    )
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    before = (
        Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by,
        _BUCKET,
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}") for v in values],
    )

    key_order = F.col(key).desc() if descending else F.col(key).asc()
    inside = (
        Window.partitionBy(*by, _BUCKET)
        .orderBy(key_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = bucketed.select(
        "*", *[F.sum(v).over(inside).alias(f"_inside_{v}") for v in values]
    )
    joined = running.join(F.broadcast(offsets), [*by, _BUCKET])
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{v}") + F.col(f"_inside_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values],
    )


def dense_ordinals(
    df: DataFrame, key: str, by: Sequence[str] = (), ordinal: str = "ordinal"
) -> DataFrame:
    """0-based position of each row in ``key`` order within its ``by`` group.

    ``key`` must be unique and numeric.
    """
    counted = prefix_sums(
        df.withColumn("_one", F.lit(1).cast("bigint")), key, ["_one"], by, descending=False
    )
    return counted.withColumn(ordinal, F.col("cum__one") - 1).drop("_one", "cum__one", "total__one")


def weighted_median(
    counts: DataFrame, value: str, n: str = "n", by: Sequence[str] = ()
) -> DataFrame:
    """Exact median per ``by`` group of a column with any number of distinct values.

    ``counts`` holds each distinct value once with its number of rows, so a value that
    many rows share is one row of the ranking.
    """
    by = list(by)
    cum, total = F.col(f"cum_{n}"), F.col(f"total_{n}")
    ranked = prefix_sums(counts, value, [n], by, descending=False)
    # The two middle ranks (equal when the count is odd), 1-based.
    low = F.floor((total + 1) / 2)
    high = F.floor((total + 2) / 2)
    first = cum - F.col(n) + 1
    covers_low = (first <= low) & (low <= cum)
    covers_high = (first <= high) & (high <= cum)
    halves = (
        F.when(covers_low, F.col(value)).otherwise(0.0)
        + F.when(covers_high, F.col(value)).otherwise(0.0)
    ) / 2
    middle = ranked.filter(covers_low | covers_high)
    return middle.groupBy(*by).agg(F.sum(halves).alias(f"median_{value}"))


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``weighted_median`` of plain rows; null values are skipped."""
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    )
    return weighted_median(settle(counts), value, "n", by)
