"""Rebalancing a rare class: weights, draws, augmentation, repeatable shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.hashing import hash_key, seeded_uniform, uniform_exceeds
from textlens.functions.scoring import safe_ratio
from textlens.functions.text import ws_tokens
from textlens.operators.lexical import class_sizes
from textlens.operators.ranking import dense_ordinals, first_rows
from textlens.session import settle


def _sizes(examples: DataFrame):
    sizes = class_sizes(examples).select(F.struct("size_pos", "size_neg")).scalar()
    return sizes["size_pos"], sizes["size_neg"]


def class_weights(examples: DataFrame, pos_ratio: float = 0.33) -> DataFrame:
    """Sampling weight per row: the positives share ``pos_ratio``, the rest the remainder."""
    size_pos, size_neg = _sizes(examples)
    weight = F.when(
        F.col("y") == 1, F.lit(pos_ratio) / F.greatest(size_pos, F.lit(1))
    ).otherwise(F.lit(1.0 - pos_ratio) / F.greatest(size_neg, F.lit(1)))
    return examples.withColumn("weight", weight)


def _fine_uniform(seed: int, purpose: str, *parts):
    """A uniform number with 53 usable bits, enough to address any number of rows."""
    coarse = seeded_uniform(purpose, seed, *parts)
    fine = seeded_uniform(purpose + "-fine", seed, *parts)
    return coarse + fine / F.lit(4294967296.0)


def draw_balanced(
    examples: DataFrame, n: int | None = None, pos_ratio: float = 0.33, seed: int = 42
) -> DataFrame:
    """n draws with replacement under ``class_weights``, as (id, y, n_draws).

    Each draw picks a class, then a member by its position in the class. Draws of the
    same member are counted before the join, so a tiny class, whose members are drawn
    very often, makes no hot key. Without ``n`` there are as many draws as rows.
    ``id`` must be unique. ``n_draws`` can serve as a row weight in training;
    ``expand_draws`` repeats the rows.
    """
    examples = settle(examples.select("id", "y"))  # read for sizes, ordinals and bounds
    members = dense_ordinals(examples.select("id", "y"), "id", ["y"])
    n = examples.count() if n is None else n
    draws = examples.sparkSession.range(n).withColumnRenamed("id", "draw")
    size_pos, size_neg = _sizes(examples)
    draw = F.col("draw")
    picked = (
        F.when(size_pos == 0, 0)
        .when(size_neg == 0, 1)
        .when(seeded_uniform("class", seed, draw) < pos_ratio, 1)
        .otherwise(0)
    )
    # The pick is settled in its own projection, then the member within the class.
    chosen = draws.select(draw, picked.alias("y"))
    size = F.when(F.col("y") == 1, size_pos).otherwise(size_neg)
    at = F.floor(_fine_uniform(seed, "member", draw) * size)
    picks = (
        chosen.select("y", F.least(at, size - 1).alias("ordinal"))
        .groupBy("y", "ordinal")
        .agg(F.count("*").alias("n_draws"))
    )
    return picks.join(members, ["y", "ordinal"]).select("id", "y", "n_draws")


def expand_draws(drawn: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row (id, y, copy) per draw. Very frequent rows are split before repeating."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_draws") - 1) / chunk))
    split = drawn.select("id", "y", "n_draws", F.explode(chunks).alias("_chunk")).repartition(
        "id", "_chunk"
    )
    first = F.col("_chunk") * chunk + 1
    last = F.least(F.col("n_draws"), (F.col("_chunk") + 1) * chunk)
    return split.select("id", "y", F.explode(F.sequence(first, last)).alias("copy"))


def positive_weight(examples: DataFrame) -> DataFrame:
    return class_sizes(examples).select(safe_ratio("size_neg", "size_pos").alias("positive_weight"))


def augment_word_deletion(
    examples: DataFrame, n_aug: int = 0, drop_prob: float = 0.10, seed: int = 42
) -> DataFrame:
    """n_aug copies of each positive, each word dropped with probability ``drop_prob``.

    Whether a word stays depends on (seed, id, copy, position) only. A copy that would
    lose every word keeps the text as it was. The copy number, from 1, is added.
    """
    positives = examples.filter(F.col("y") == 1)
    if n_aug < 1:
        return positives.withColumn("copy", F.lit(1)).limit(0)
    # Split and keyed once per row; only the position is added per word.
    copies = positives.withColumn("_words", ws_tokens("text")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(n_aug)))
    )
    keyed = copies.withColumn("_key", hash_key(seed, F.col("id"), F.col("copy")))

    def stays(_, position):
        key = F.concat(F.col("_key"), F.lit("|"), position.cast("string"))
        return uniform_exceeds(key, drop_prob)

    return (
        keyed.withColumn("_kept", F.filter("_words", stays))
        .withColumn(
            "text",
            F.when(F.size("_kept") > 0, F.array_join("_kept", " ")).otherwise(F.col("text")),
        )
        .drop("_kept", "_words", "_key")
    )


def append_augmented(examples: DataFrame, augmented: DataFrame) -> DataFrame:
    """Originals (copy 0) and their augmented copies."""
    return examples.withColumn("copy", F.lit(0)).unionByName(augmented)


def shuffle_rows(df: DataFrame, seed: int = 42, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Seeded random order: a distributed sort on a hash of the row's key.

    The sort key stays as ``shuffle_key`` so that a written table keeps the order.
    """
    u = seeded_uniform("shuffle", seed, *[F.col(k) for k in keys])
    return df.withColumn("shuffle_key", u).orderBy("shuffle_key", *keys)


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """n random rows, the same ones on every run."""
    u = seeded_uniform("sample", seed, *[F.col(k) for k in keys])
    order = [F.col("_u").asc(), *[F.col(k).asc() for k in keys]]
    return first_rows(df.withColumn("_u", u), n, order).drop("_u")
