"""Lexical contrast of the two classes.

Class sizes are taken from the labels alone: document ids are unique (``check_unique_key``),
so joining the texts adds no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.operators import lexical
from textlens.operators.joins import class_contrast_join
from textlens.plans import fixtures as fx
from textlens.plans.registry import query

_STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)


def _grams(n: int) -> str:
    """SQL: (y, term) per n-gram occurrence."""
    joined = " || ' ' || ".join(f"toks[i + {j}]" for j in range(n))
    return f"""SELECT y, unnest(list_transform(range(1, len(toks) - {n - 2}), lambda i: {joined})) AS term
      FROM tok WHERE len(toks) >= {n}"""


def _ranked(n: int, k: int, without_stop_words: bool = False) -> str:
    stop = f"WHERE term NOT IN ({_STOP})" if without_stop_words else ""
    return f""", g AS ({_grams(n)}),
    c AS (SELECT y, term, count(*) AS n FROM g {stop} GROUP BY y, term),
    r AS (SELECT y::INTEGER AS y,
                 (row_number() OVER (PARTITION BY y ORDER BY n DESC, term))::INTEGER AS rank, term, n
          FROM c QUALIFY rank <= {k}),
    w AS (SELECT term, coalesce(sum(n) FILTER (y = 1), 0)::BIGINT AS n_pos,
                 coalesce(sum(n) FILTER (y = 0), 0)::BIGINT AS n_neg FROM c GROUP BY term)
    """


@query("top_bigrams", _ranked(2, 15) + "SELECT y, rank, term, n FROM r")
def _(spark, sf):
    return lexical.top_ngrams(fx.tokens(spark, sf), 2, 15)


@query("top_trigrams", _ranked(3, 15) + "SELECT y, rank, term, n FROM r")
def _(spark, sf):
    return lexical.top_ngrams(fx.tokens(spark, sf), 3, 15)


# Trigrams to look up; the last one never occurs.
_WANTED = ("the the the", "and and and", "hehely hehely hehely", "attion to thanedble", "no such term")
_WANTED_SQL = ", ".join(f"('{t}')" for t in _WANTED)


@query(
    "restrict_to_vocabulary",
    _ranked(3, 15)
    + f"""SELECT v.term, coalesce(n_pos, 0)::BIGINT AS n_pos, coalesce(n_neg, 0)::BIGINT AS n_neg
    FROM (VALUES {_WANTED_SQL}) AS v(term) LEFT JOIN w ON w.term = v.term""",
)
def _(spark, sf):
    wanted = spark.createDataFrame([(t,) for t in _WANTED], "term string")
    return lexical.restrict_to_vocabulary(fx.tokens(spark, sf), wanted, 3)


@query(
    "ngram_rates",
    _ranked(3, 15)
    + f"""SELECT v.term, coalesce(n_pos, 0)::BIGINT AS n_pos, coalesce(n_neg, 0)::BIGINT AS n_neg,
      round(100.0 * coalesce(n_pos, 0) / np, 6) AS rate_pos,
      round(100.0 * coalesce(n_neg, 0) / nn, 6) AS rate_neg
    FROM (VALUES {_WANTED_SQL}) AS v(term) CROSS JOIN size LEFT JOIN w ON w.term = v.term""",
)
def _(spark, sf):
    return lexical.ngram_rates(fx.tokens(spark, sf), _WANTED, 3, fx.labels(spark, sf))


@query(
    "ngram_enrichment",
    _ranked(3, 8)
    + """SELECT w.term, w.n_pos, w.n_neg, round(100.0 * n_pos / np, 6) AS rate_pos,
      round(100.0 * n_neg / nn, 6) AS rate_neg,
      round((100.0 * n_pos / np)
            / CASE WHEN n_neg = 0 THEN 0.000001::DOUBLE ELSE 100.0 * n_neg / nn END, 6) AS ratio
    FROM r JOIN w ON w.term = r.term, size WHERE r.y = 1""",
)
def enrichment(spark, sf):
    return lexical.ngram_enrichment(fx.tokens(spark, sf), examples=fx.labels(spark, sf))


@query(
    "stop_word_density",
    f""", d AS (
      SELECT y, 100.0::DOUBLE * len(list_filter(toks, lambda t: t IN ({_STOP}))) / len(toks) AS density
      FROM tok WHERE len(toks) > 0)
    SELECT y::INTEGER AS y, count(*) AS n_docs, round(avg(density), 6) AS mean_density,
      round(median(density), 6) AS median_density, round(stddev_pop(density), 6) AS std_density,
      round((SELECT avg(density) FILTER (y = 1) - avg(density) FILTER (y = 0) FROM d), 6)
        AS difference_pos_neg
    FROM d GROUP BY y""",
)
def _(spark, sf):
    return lexical.stop_word_density(fx.tokens(spark, sf), fx.STOP_WORDS)


@query(
    "top_content_words",
    _ranked(1, 20, True)
    + """SELECT y, rank, term, n,
      round(100.0 * n / CASE WHEN y = 1 THEN np ELSE nn END, 6) AS pct FROM r, size""",
)
def _(spark, sf):
    return lexical.top_content_words(
        fx.tokens(spark, sf), fx.STOP_WORDS, examples=fx.labels(spark, sf)
    )


@query(
    "distinctive_words",
    _ranked(1, 20, True)
    + """SELECT r.rank, r.term, n_pos, n_neg, round(100.0 * n_pos / np, 6) AS rate_pos,
      round(100.0 * n_neg / nn, 6) AS rate_neg,
      round((100.0 * n_pos / np)
            / CASE WHEN n_neg = 0 THEN 0.000001::DOUBLE ELSE 100.0 * n_neg / nn END, 6) AS ratio,
      r.term NOT IN (SELECT term FROM r WHERE y = 0) AS only_pos
    FROM r JOIN w ON w.term = r.term, size WHERE r.y = 1""",
)
def _(spark, sf):
    return lexical.distinctive_words(
        fx.tokens(spark, sf), fx.STOP_WORDS, examples=fx.labels(spark, sf)
    )


@query(
    "term_weights",
    _ranked(1, 100, True)
    + """SELECT y, rank, term, n, round(n::DOUBLE / max(n) OVER (PARTITION BY y), 6) AS weight FROM r""",
)
def _(spark, sf):
    return lexical.term_weights(fx.tokens(spark, sf), fx.STOP_WORDS)


@query(
    "ngram_table_side_by_side",
    _ranked(2, 10)
    + """, p AS (SELECT * FROM r WHERE y = 1), q AS (SELECT * FROM r WHERE y = 0)
    SELECT coalesce(p.rank, q.rank) AS rank, p.term AS term_pos, p.n AS n_pos, q.term AS term_neg,
      q.n AS n_neg, round(100.0 * p.n / np, 6) AS pct_pos, round(100.0 * q.n / nn, 6) AS pct_neg
    FROM p FULL JOIN q ON p.rank = q.rank CROSS JOIN size""",
)
def _(spark, sf):
    return lexical.ngram_table_side_by_side(
        fx.tokens(spark, sf), 2, 10, fx.labels(spark, sf)
    )


@query(
    "rank_terms",
    _ranked(1, 50, False) + "SELECT y, rank, term, n FROM r",
)
def _(spark, sf):
    return lexical.rank_terms(lexical.class_term_counts(fx.tokens(spark, sf)), 50)


# More terms than Spark prunes below the shuffle by itself.
@query("top_k_terms", _ranked(1, 1500) + "SELECT y, rank, term, n FROM r")
def _(spark, sf):
    return lexical.rank_terms(lexical.class_term_counts(fx.tokens(spark, sf)), 1500)


@query(
    "class_contrast_join",
    _ranked(2, 15) + "SELECT term, n_pos, n_neg FROM w",
)
def _(spark, sf):
    grams = lexical.explode_ngrams(fx.tokens(spark, sf), 2)
    return class_contrast_join(grams.groupBy("y", "term").agg(F.count("*").alias("n")), "term")


@query(
    "shared_terms",
    _ranked(1, 20, True)
    + "SELECT term FROM r WHERE y = 1 AND term IN (SELECT term FROM r WHERE y = 0)",
)
def _(spark, sf):
    return lexical.shared_terms(lexical.top_content_words(fx.tokens(spark, sf), fx.STOP_WORDS))


@query(
    "only_in_class",
    _ranked(1, 20, True)
    + "SELECT term FROM r WHERE y = 1 AND term NOT IN (SELECT term FROM r WHERE y = 0)",
)
def _(spark, sf):
    return lexical.only_in_class(lexical.top_content_words(fx.tokens(spark, sf), fx.STOP_WORDS))
