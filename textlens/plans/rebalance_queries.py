"""Weights, draws and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import rebalance
from textlens.plans import fixtures as fx
from textlens.plans.registry import PIECES, query, u


@query(
    "class_weights",
    """SELECT id, y::INTEGER AS y,
      round(1000 * CASE WHEN y = 1 THEN 0.33::DOUBLE / np ELSE 0.67::DOUBLE / nn END, 6) AS weight_1000
    FROM lab, size""",
)
def _(spark, sf):
    weighted = rebalance.class_weights(fx.labels(spark, sf))
    return weighted.select("id", "y", (F.col("weight") * 1000).alias("weight_1000"))


_DRAWS = f""", m AS (
      SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS ordinal FROM lab),
    d AS (SELECT row_number() OVER (ORDER BY id) - 1 AS draw FROM lab),
    c AS (SELECT draw, CASE WHEN {u("'class'", "42", "draw")} < 0.33 THEN 1 ELSE 0 END AS y FROM d),
    o AS (SELECT c.y, floor(({u("'member'", "42", "draw")}
          + {u("'member-fine'", "42", "draw")} / 4294967296.0::DOUBLE)
          * CASE WHEN c.y = 1 THEN np ELSE nn END)::BIGINT AS ordinal FROM c, size),
    picks AS (SELECT m.id, m.y, count(*) AS n_draws
      FROM o JOIN m ON m.y = o.y AND m.ordinal = o.ordinal GROUP BY m.id, m.y)
    """


@query("draw_balanced", _DRAWS + "SELECT id, y::INTEGER AS y, n_draws FROM picks")
def _(spark, sf):
    return rebalance.draw_balanced(fx.labels(spark, sf))


@query(
    "expand_draws",
    _DRAWS + "SELECT id, y::INTEGER AS y, unnest(range(1, n_draws + 1)) AS copy FROM picks",
)
def _(spark, sf):
    return rebalance.expand_draws(rebalance.draw_balanced(fx.labels(spark, sf)))


@query("positive_weight", "SELECT round(nn::DOUBLE / np, 6) AS positive_weight FROM size")
def _(spark, sf):
    return rebalance.positive_weight(fx.labels(spark, sf))


_AUGMENTED = f""", w AS (SELECT id, y, text, {PIECES} AS words FROM ex WHERE y = 1),
    a AS (SELECT w.*, unnest(range(1, 4)) AS copy FROM w),
    kept AS (SELECT a.*, list_filter(words, lambda p, i: {u("42", "id", "copy", "i - 1")} > 0.1) AS k
      FROM a),
    aug AS (SELECT id, copy::INTEGER AS copy,
      CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS text FROM kept)
    """


def _augmented(rows):
    return rebalance.augment_word_deletion(rows, n_aug=3)


@query("augment_word_deletion", _AUGMENTED + "SELECT id, copy, text FROM aug")
def _(spark, sf):
    return _augmented(fx.examples(spark, sf)).select("id", "copy", "text")


@query(
    "append_augmented",
    _AUGMENTED
    + "SELECT id, copy, text FROM aug UNION ALL SELECT id, 0::INTEGER AS copy, text FROM ex",
)
def _(spark, sf):
    rows = fx.examples(spark, sf)
    return rebalance.append_augmented(rows, _augmented(rows)).select("id", "copy", "text")


@query("shuffle_rows", f"SELECT id, round({u(repr('shuffle'), '42', 'id')}, 6) AS shuffle_key FROM lab")
def _(spark, sf):
    return rebalance.shuffle_rows(fx.labels(spark, sf)).select("id", "shuffle_key")


@query(
    "sample_rows",
    f"SELECT id, keyword, text FROM ex ORDER BY {u(repr('sample'), '42', 'id')}, id LIMIT 5",
)
def _(spark, sf):
    return rebalance.sample_rows(fx.examples(spark, sf), 5).select("id", "keyword", "text")
