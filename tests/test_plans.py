"""What the plans must and must not contain, and results with one dominating key."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from textlens.plans import QUERIES
from textlens.operators import joins, lexical, metrics, modelling, ranking, rebalance
from textlens.plans import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
TOKENISER = r"regexp_extract_all\(lower\("


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines_with(df, pattern: str) -> list[str]:
    return [line for line in plan(df).splitlines() if re.search(pattern, line)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product_and_no_row_python(spark, name):
    if name.startswith(("train_", "training_", "label_heads_", "cross_validated_")):
        pytest.skip("the fit runs when the query is built")
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if not name.startswith("score_batches"):
        assert "MapInPandas" not in text


@pytest.mark.parametrize(
    "name",
    ["ngram_enrichment", "top_bigrams", "top_trigrams", "top_content_words", "vocabulary",
     "distinctive_words", "token_length_stats", "length_histogram"],
)
def test_texts_are_tokenised_once(spark, name):
    assert len(lines_with(QUERIES[name](spark, SF_DIR), TOKENISER)) == 1


def test_top_k_is_cut_below_the_shuffle(spark):
    text = plan(QUERIES["top_trigrams"](spark, SF_DIR))
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert "rangepartitioning" not in text


@pytest.mark.parametrize(
    "name",
    ["ngram_enrichment", "hardest_false_positives", "hardest_false_negatives", "sample_rows",
     "threshold_sweep", "search_runs", "worst_groups"],
)
def test_first_rows_need_no_full_sort(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_label_queries_do_not_read_texts(spark):
    for name in ("class_distribution", "average_precision", "threshold_sweep", "draw_balanced"):
        schemas = lines_with(QUERIES[name](spark, SF_DIR), r"ReadSchema")
        assert not [line for line in schemas if re.search(r"ReadSchema.*text:", line)]


def test_table_comparison_shuffles_hashes_only(spark):
    documents = fx.corpus(spark, SF_DIR)
    df = joins.compare_tables(documents, documents, "id", ["keyword", "text"])
    shuffles = lines_with(df, r"Exchange hashpartitioning")
    assert len(shuffles) == 1
    assert "partial_sum" in plan(df)


def test_spread_leaves_inputs_with_enough_splits_alone(spark):
    one = spark.range(0, 1000, 1, 1).toDF("id")
    many = spark.range(0, 1000, 1, 64).toDF("id")
    assert "REPARTITION_BY_NUM" in plan(joins.spread(one, one))
    assert "REPARTITION_BY_NUM" not in plan(joins.spread(many, many))


# --- one key, class or value holds a third or more of all rows ------------------------


def test_join_with_a_dominating_key_on_either_side(spark):
    n = 3000
    hot = F.when(F.col("id") < n // 3, 7).otherwise(F.col("id"))
    labels = spark.range(n).select(hot.alias("id"), F.col("id").alias("row"))
    corpus = spark.range(2000).select("id", F.lit("t").alias("text"))
    assert joins.attach_text(labels, corpus).count() == n
    assert joins.attach_text(labels, corpus).filter("text IS NULL").count() == 1000
    repeated = spark.range(n).select(hot.alias("id"), F.lit("t").alias("text"))
    few = spark.createDataFrame([(7, "a"), (7, "b"), (2999, "c"), (-1, "d")], "id bigint, label string")
    assert joins.attach_text(few, repeated).count() == 2 * 1000 + 1 + 1


def test_adaptive_execution_splits_a_dominating_key_on_both_sides(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        hot = F.when(F.col("id") < n // 3, -7).otherwise(F.col("id"))
        corpus = spark.range(0, n, 1, 8).select(hot.alias("id"), F.md5(F.col("id").cast("string")).alias("text"))
        labels = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") == 0, -7).otherwise(F.col("id")).alias("id"), F.lit("x").alias("label")
        )
        df = joins.attach_text(labels, corpus)
        assert df.count() == n // 3 + (n - n // 3) + (n // 3 - 1)
        final = df.agg(F.count("text"))
        final.collect()
        assert "skew=true" in plan(final)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_comparison_with_a_dominating_key(spark):
    n = 3000
    key = F.when(F.col("id") < n // 3, 7).otherwise(F.col("id"))
    left = spark.range(n).select(key.alias("id"), F.col("id").cast("string").alias("text"))
    assert joins.compare_tables(left, left.repartition(7), "id", ["text"]).count() == 0
    changed = left.withColumn("text", F.when(F.col("text") == "5", "other").otherwise(F.col("text")))
    found = joins.compare_tables(left, changed, "id", ["text"]).collect()
    assert [tuple(r) for r in found] == [(7, "text", "differs")]
    shorter = left.filter("text <> '5'")
    assert [tuple(r) for r in joins.compare_tables(left, shorter, "id", ["text"]).collect()] == [
        (7, None, "row_count")
    ]


def test_prefix_sums_with_close_values(spark):
    # A third of the distinct values lies within a millionth of 1.
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 1 - F.col("id") / 1e9).otherwise(F.col("id") / 4000).alias("score"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    df = metrics.score_totals(rows)
    got = ranking.prefix_sums(df, "score", ["n"], buckets=16)
    assert got.agg(F.max("cum_n"), F.count_distinct("cum_n")).first() == (3000, 3000)
    sizes = ranking._bucketed(df, "score", 16).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert sizes <= 3000 / 16 * 2.1


def test_draws_from_a_single_positive(spark):
    df = spark.range(999).select("id", (F.col("id") == 5).cast("int").alias("y"))
    drawn = rebalance.draw_balanced(df)
    rows = {r.id: r.n_draws for r in drawn.collect()}
    assert sum(rows.values()) == 999 and abs(rows[5] - 333) < 60
    assert rebalance.expand_draws(drawn, chunk=10).count() == 999


def test_naive_bayes_with_a_dominating_term(spark, monkeypatch):
    rows = [(i, i % 2, ["the"] * 5 + [f"w{i % 40}", f"c{i % 2}"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, y int, tokens array<string>")
    scores = {}
    for hot_terms in (1, 3, 10_000):
        monkeypatch.setattr(modelling, "HOT_TERMS", hot_terms)
        model = modelling.train_naive_bayes(df)
        assert model.weights.filter("hot").count() <= hot_terms
        scores[hot_terms] = {r.id: r.log_odds for r in modelling.naive_bayes_scores(model, df).collect()}
    for other in (3, 10_000):
        assert scores[other] == pytest.approx(scores[1])
    assert all((v > 0) == (i % 2 == 1) for i, v in scores[1].items())
    nothing = spark.createDataFrame([(1, [])], "id bigint, tokens array<string>")
    assert modelling.naive_bayes_scores(model, nothing).first().log_odds == pytest.approx(0.0)


def test_counts_with_a_dominating_term_and_source(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(
            F.array(F.concat(F.lit("t"), F.col("id").cast("string")))
        ).alias("tokens"),
    )
    top = lexical.top_ngrams(rows, 1, 2).filter("rank = 1").collect()
    assert {(r.y, r.term, r.n) for r in top} == {(0, "hot", 500), (1, "hot", 500)}
    assert "partial_count" in plan(lexical.class_term_counts(rows))
