"""Lexical contrast of two classes: n-grams, rates, enrichment, stop words.

The common shape is one pass over the texts: explode terms, count them per class in
one row per term (``class_term_counts``), then pick the few rows a report shows. The
partial aggregation below the shuffle absorbs frequent terms, and picking never sends
a whole class to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.scoring import percent_of, safe_ratio
from textlens.operators.ranking import first_rows, top_k, weighted_median
from textlens.session import settle

# A rate of zero is replaced by this before dividing (fixed value).
RATE_FLOOR = 1e-6


def explode_tokens(
    tokens: DataFrame, keep: Sequence[str] = ("y",), term: str = "term"
) -> DataFrame:
    """One row per token.

    An inner explode makes the optimizer test the array's size first, and push that test
    with the tokenising below the scan's other work, so that texts are tokenised twice.
    The outer form does not; the null row of an empty array is dropped afterwards.
    """
    rows = tokens.select(*keep, F.explode_outer("tokens").alias(term))
    return rows.filter(F.col(term).isNotNull())


def explode_ngrams(
    tokens: DataFrame, n: int, keep: Sequence[str] = ("y",), term: str = "term"
) -> DataFrame:
    """One row per n-gram occurrence within a document.

    Shifted slices of the token array are zipped and unnested, which stays in generated
    code; the joined string is made once per row and no array of strings is built.
    """
    keep = list(keep)
    if "text" in tokens.columns:
        # Drops rows without a text at the scan, before tokenising.
        tokens = tokens.filter(F.col("text").isNotNull())
    if n == 1:
        return explode_tokens(tokens, keep, term)
    parts = [f"_w{i}" for i in range(n)]
    shifted = tokens.select(
        *keep,
        F.col("tokens").alias(parts[0]),
        *[F.slice("tokens", F.lit(i + 1), F.size("tokens")).alias(parts[i]) for i in range(1, n)],
    )
    rows = shifted.select(*keep, F.inline(F.arrays_zip(*parts)))
    # The shorter slices are padded with nulls: those are the incomplete tails.
    return rows.filter(F.col(parts[-1]).isNotNull()).select(
        *keep, F.concat_ws(" ", *parts).alias(term)
    )


def class_sizes(examples: DataFrame) -> DataFrame:
    """One row: number of documents per class."""
    return examples.agg(
        F.count_if(F.col("y") == 1).alias("size_pos"),
        F.count_if(F.col("y") == 0).alias("size_neg"),
    )


def _size_columns(examples: DataFrame) -> tuple[Column, Column]:
    """Class sizes from one scalar subquery."""
    sizes = class_sizes(examples).select(F.struct("size_pos", "size_neg")).scalar()
    return sizes["size_pos"], sizes["size_neg"]


def class_term_counts(
    tokens: DataFrame, n: int = 1, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """One row per n-gram with its occurrences in either class: (term, n_pos, n_neg).

    Occurrences, not documents: a term repeated in one text counts each time.
    """
    terms = explode_ngrams(tokens, n)
    if stop_words:
        terms = terms.filter(~F.col("term").isin(list(stop_words)))
    return terms.groupBy("term").agg(
        F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg")
    )


def _top_terms(counts: DataFrame, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """Top-k terms per class as (y, rank, term, n), count descending, term ascending."""
    per_class = counts.select(
        "term",
        *carry,
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("y"), F.col("n_pos").alias("n")),
                F.struct(F.lit(0).alias("y"), F.col("n_neg").alias("n")),
            )
        ),
    ).filter(F.col("n") > 0)
    return top_k(per_class, k, ["y"], [F.col("n").desc(), F.col("term").asc()]).select(
        "y", "rank", "term", "n", *carry
    )


def rank_terms(counts: DataFrame, k: int) -> DataFrame:
    """Rank of each of the k most frequent terms within its class."""
    return _top_terms(counts, k)


def top_ngrams(tokens: DataFrame, n: int = 2, k: int = 15) -> DataFrame:
    return _top_terms(class_term_counts(tokens, n), k)


def restrict_to_vocabulary(
    tokens: DataFrame, vocabulary: DataFrame | Sequence[str], n: int = 3
) -> DataFrame:
    """Occurrences per class of given n-grams; a listed term that never occurs gets 0.

    A Python list is matched while counting. A table may have any size: terms are
    counted first and joined afterwards, one row each, so a frequent term cannot make
    the join uneven.
    """
    if isinstance(vocabulary, DataFrame):
        listed = vocabulary.select("term").distinct()
        counts = class_term_counts(tokens, n)
    else:
        wanted = list(dict.fromkeys(vocabulary))
        listed = tokens.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
        counts = (
            explode_ngrams(tokens, n)
            .filter(F.col("term").isin(wanted))
            .groupBy("term")
            .agg(
                F.count_if(F.col("y") == 1).alias("n_pos"),
                F.count_if(F.col("y") == 0).alias("n_neg"),
            )
        )
    return listed.join(counts, "term", "left").fillna(0, ["n_pos", "n_neg"])


def _with_rates(counts: DataFrame, examples: DataFrame) -> DataFrame:
    size_pos, size_neg = _size_columns(examples)
    return counts.withColumns(
        {"rate_pos": percent_of("n_pos", size_pos), "rate_neg": percent_of("n_neg", size_neg)}
    )


def ngram_rates(
    tokens: DataFrame,
    vocabulary: DataFrame | Sequence[str],
    n: int = 3,
    examples: DataFrame | None = None,
) -> DataFrame:
    """Counts and occurrences per 100 documents of given n-grams in either class."""
    return _with_rates(restrict_to_vocabulary(tokens, vocabulary, n), tokens if examples is None else examples)


def ngram_enrichment(
    tokens: DataFrame,
    n: int = 3,
    top: int = 8,
    floor: float = RATE_FLOOR,
    examples: DataFrame | None = None,
) -> DataFrame:
    """The positive class's most frequent n-grams with their rate in either class.

    Both counts of a term are in one row, so the ranking needs no second scan and no
    join; each task keeps ``top`` rows. ``examples`` gives the class sizes where a
    narrower plan than that of ``tokens`` has the same rows.
    """
    counts = class_term_counts(tokens, n).filter(F.col("n_pos") > 0)
    best = first_rows(counts, top, [F.col("n_pos").desc(), F.col("term").asc()])
    rated = _with_rates(best, tokens if examples is None else examples)
    divisor = F.when(F.col("rate_neg") == 0, F.lit(floor)).otherwise(F.col("rate_neg"))
    return rated.withColumn("ratio", F.col("rate_pos") / divisor)


def stop_word_share(stop_words: Sequence[str], tokens: str = "tokens") -> Column:
    """Percent of a document's tokens that are stop words; null without tokens.

    The list is a literal set, so each token costs one hash look-up.
    """
    hits = F.size(F.filter(tokens, lambda t: t.isin(list(stop_words))))
    return F.when(F.size(tokens) > 0, F.lit(100.0) * hits / F.size(tokens))


def stop_word_density(tokens: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Mean, exact median and population deviation of the stop-word share per class.

    Also the positive mean minus the negative mean, in percentage points. Documents per
    distinct share are counted in one pass over the texts; all figures come from there.
    """
    counts = (
        tokens.select("y", stop_word_share(stop_words).alias("density"))
        .groupBy("y", "density")
        .agg(F.count("*").alias("n"))
    )
    # Documents without tokens are dropped from the settled counts: asked for earlier,
    # the test would be pushed to the scan and compute the share a second time.
    counts = settle(counts).filter(F.col("density").isNotNull())
    n, share = F.col("n"), F.col("density")
    means = counts.groupBy("y").agg(F.sum(n).alias("n_docs"), F.sum(n * share).alias("_sum"))
    means = means.select("y", "n_docs", safe_ratio("_sum", "n_docs").alias("mean_density"))
    # Around the mean of the class: squares of the shares themselves would cancel. Two rows.
    apart = share - F.col("mean_density")
    squares = counts.join(F.broadcast(means), "y").groupBy("y").agg(F.sum(n * apart * apart).alias("_squares"))
    moments = means.join(squares, "y").select(
        "y", "n_docs", "mean_density", F.sqrt(safe_ratio("_squares", "n_docs")).alias("std_density")
    )

    def of_class(y: int) -> Column:
        return F.max(F.when(F.col("y") == y, F.col("mean_density")))

    difference = moments.agg((of_class(1) - of_class(0)).alias("d")).scalar()
    medians = weighted_median(counts, "density", "n", ["y"])
    return moments.join(medians, "y").select(
        "y",
        "n_docs",
        "mean_density",
        "median_density",
        "std_density",
        difference.alias("difference_pos_neg"),
    )


def top_content_words(
    tokens: DataFrame,
    stop_words: Sequence[str],
    k: int = 20,
    examples: DataFrame | None = None,
) -> DataFrame:
    """Top-k words per class without stop words, with occurrences per 100 documents."""
    ranked = _top_terms(class_term_counts(tokens, 1, stop_words), k)
    size_pos, size_neg = _size_columns(tokens if examples is None else examples)
    size = F.when(F.col("y") == 1, size_pos).otherwise(size_neg)
    return ranked.withColumn("pct", percent_of("n", size))


def distinctive_words(
    tokens: DataFrame,
    stop_words: Sequence[str],
    k: int = 20,
    floor: float = RATE_FLOOR,
    examples: DataFrame | None = None,
) -> DataFrame:
    """Positive top-k words, their rates, and whether the negative top-k lacks them."""
    counts = class_term_counts(tokens, 1, stop_words)
    # Both counts travel with a term's rank, so its rates need no second look-up.
    tops = _top_terms(counts, k, carry=("n_pos", "n_neg"))
    listed = tops.groupBy("term", "n_pos", "n_neg").agg(
        F.max(F.when(F.col("y") == 1, F.col("rank"))).alias("rank"),
        F.max(F.when(F.col("y") == 0, F.col("rank"))).alias("_rank_neg"),
    )
    rated = _with_rates(listed.filter(F.col("rank").isNotNull()), tokens if examples is None else examples)
    divisor = F.when(F.col("rate_neg") == 0, F.lit(floor)).otherwise(F.col("rate_neg"))
    return rated.select(
        "rank",
        "term",
        "n_pos",
        "n_neg",
        "rate_pos",
        "rate_neg",
        (F.col("rate_pos") / divisor).alias("ratio"),
        F.col("_rank_neg").isNull().alias("only_pos"),
    )


def term_weights(
    tokens: DataFrame, stop_words: Sequence[str], max_terms: int = 100
) -> DataFrame:
    """Top terms per class with weight = count / largest count of the class."""
    ranked = _top_terms(class_term_counts(tokens, 1, stop_words), max_terms)
    # 2 * max_terms rows.
    largest = F.max("n").over(Window.partitionBy("y"))
    return ranked.withColumn("weight", safe_ratio("n", largest))


def ngram_table_side_by_side(
    tokens: DataFrame, n: int = 2, k: int = 10, examples: DataFrame | None = None
) -> DataFrame:
    """Rank-aligned n-grams of both classes; a shorter list leaves nulls."""
    ranked = top_ngrams(tokens, n, k)
    size_pos, size_neg = _size_columns(tokens if examples is None else examples)

    def of(y: int, column: str) -> Column:
        return F.max(F.when(F.col("y") == y, F.col(column)))

    table = ranked.groupBy("rank").agg(
        of(1, "term").alias("term_pos"),
        of(1, "n").alias("n_pos"),
        of(0, "term").alias("term_neg"),
        of(0, "n").alias("n_neg"),
    )
    return table.select(
        "rank",
        "term_pos",
        "n_pos",
        F.when(F.col("n_pos").isNotNull(), percent_of("n_pos", size_pos)).alias("pct_pos"),
        "term_neg",
        "n_neg",
        F.when(F.col("n_neg").isNotNull(), percent_of("n_neg", size_neg)).alias("pct_neg"),
    )


def shared_terms(ranked: DataFrame) -> DataFrame:
    """Terms in the top list of both classes."""
    positive = ranked.filter(F.col("y") == 1).select("term")
    negative = ranked.filter(F.col("y") == 0).select("term")
    return positive.intersect(negative)


def only_in_class(ranked: DataFrame, y: int = 1) -> DataFrame:
    """Terms in the top list of one class and not in the other's."""
    mine = ranked.filter(F.col("y") == y).select("term")
    other = ranked.filter(F.col("y") != y).select("term")
    return mine.exceptAll(other)
