"""Profile of the labelled documents."""

from __future__ import annotations

from textlens.operators import profile
from textlens.plans import fixtures as fx
from textlens.plans.registry import query


@query(
    "class_distribution",
    """SELECT np AS n_pos, nn AS n_neg, np + nn AS n_total,
         round(100.0 * np / (np + nn), 6) AS pct_pos, round(100.0 * nn / (np + nn), 6) AS pct_neg,
         round(nn::DOUBLE / np, 6) AS imbalance_ratio FROM size""",
)
def _(spark, sf):
    return profile.class_distribution(fx.examples(spark, sf))


@query(
    "label_frequency",
    """SELECT 0 AS label_ix, sum(l0)::BIGINT AS n, round(100.0 * sum(l0) / count(*), 6)::DOUBLE AS pct
    FROM lab UNION ALL
    SELECT 1, sum(l1)::BIGINT, round(100.0 * sum(l1) / count(*), 6)::DOUBLE FROM lab""",
)
def _(spark, sf):
    return profile.label_frequency(fx.labels(spark, sf))


@query(
    "labels_per_row_histogram",
    "SELECT (l0 + l1)::BIGINT AS n_labels, count(*) AS n_rows FROM lab GROUP BY 1",
)
def _(spark, sf):
    return profile.labels_per_row_histogram(fx.labels(spark, sf))


@query(
    "labels_per_row_stats",
    """SELECT round(avg(l0 + l1), 6) AS mean_labels, min(l0 + l1)::BIGINT AS min_labels,
         max(l0 + l1)::BIGINT AS max_labels,
         count(*) FILTER (l0 + l1 = 1) AS n_single,
         round(100.0 * count(*) FILTER (l0 + l1 = 1) / count(*), 6) AS pct_single,
         count(*) FILTER (l0 + l1 > 1) AS n_multi,
         round(100.0 * count(*) FILTER (l0 + l1 > 1) / count(*), 6) AS pct_multi,
         round(100.0 * count(*) FILTER (l0 + l1 > 1) / count(*) FILTER (y = 1), 6) AS pct_multi_of_pos
    FROM lab""",
)
def _(spark, sf):
    return profile.labels_per_row_stats(fx.labels(spark, sf))


@query(
    "token_length_stats",
    """SELECT round(avg(len(toks)), 6) AS mean_tokens, median(len(toks))::DOUBLE AS median_tokens,
         min(len(toks))::BIGINT AS min_tokens, max(len(toks))::BIGINT AS max_tokens,
         round(stddev_samp(len(toks)), 6) AS std_tokens FROM tok""",
)
def _(spark, sf):
    return profile.token_length_stats(fx.tokens(spark, sf))


@query(
    "vocabulary",
    "SELECT term, count(*) AS n FROM (SELECT unnest(toks) AS term FROM tok) GROUP BY term",
)
def _(spark, sf):
    return profile.vocabulary(fx.tokens(spark, sf))


@query(
    "vocabulary_size",
    "SELECT count(DISTINCT term) AS vocabulary_size FROM (SELECT unnest(toks) AS term FROM tok)",
)
def _(spark, sf):
    return profile.vocabulary_size(fx.tokens(spark, sf))


@query(
    "length_histogram",
    """, n AS (SELECT len(toks)::DOUBLE AS x FROM tok),
    r AS (SELECT min(x) AS lo, max(x) AS hi FROM n),
    b AS (SELECT least(floor((x - lo) * 50 / (hi - lo)), 49)::BIGINT AS bin, count(*) AS n
          FROM n, r GROUP BY 1)
    SELECT g.bin::BIGINT AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS bin_low,
           round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS bin_high, coalesce(b.n, 0)::BIGINT AS n
    FROM (SELECT unnest(range(0, 50)) AS bin) g CROSS JOIN r LEFT JOIN b ON b.bin = g.bin""",
)
def _(spark, sf):
    return profile.length_histogram(fx.tokens(spark, sf))


@query(
    "length_coverage",
    """SELECT l.x::BIGINT AS max_tokens, count(*) FILTER (len(toks) <= l.x) AS n_within,
         count(*) AS n_total,
         round(count(*) FILTER (len(toks) <= l.x)::DOUBLE / count(*), 6) AS share
    FROM tok, (VALUES (128), (256)) AS l(x) GROUP BY l.x""",
)
def _(spark, sf):
    return profile.length_coverage(fx.tokens(spark, sf))
