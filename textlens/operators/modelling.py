"""Training and scoring on Spark: MLlib pipelines, batch inference, naive Bayes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from textlens.functions.scoring import decide, sigmoid
from textlens.functions.text import WORD_PATTERN
from textlens.operators.lexical import class_sizes, class_term_counts
from textlens.operators.metrics import ensemble_mean
from textlens.session import settle, shared_path


def text_features(num_features: int = 1 << 18, text: str = "text") -> list:
    """Stages from a text column to hashed, weighted uni- and bigram counts."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD_PATTERN, gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(numFeatures=num_features, inputCol="_terms", outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def _without_null_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def _without_summary(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The model as it is read back from shared storage, without its training summary.

    The summary of a binary fit holds the session, and a model is sent to the tasks whole: once
    the session has observed metrics, it can no longer be sent.
    """
    path = shared_path(spark, "classifier")
    model.save(path)
    return LogisticRegressionModel.load(path)


def train_text_classifiers(
    weighted: DataFrame,
    reg_params: Sequence[float],
    num_features: int = 1 << 18,
    max_iter: int = 20,
) -> list[PipelineModel]:
    """Weighted logistic regression on texts, one per regularisation, on shared features.

    Input has text, y and weight columns. Gradients are combined in a tree of executors;
    the driver holds one weight vector.
    """
    rows = _without_null_texts(weighted)
    features = Pipeline(stages=text_features(num_features)).fit(rows)
    shared = features.transform(rows).select("features", F.col("y").cast("double"), "weight")
    shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        heads = [
            LogisticRegression(
                labelCol="y",
                weightCol="weight",
                maxIter=max_iter,
                regParam=reg_param,
                aggregationDepth=3,
            ).fit(shared)
            for reg_param in reg_params
        ]
    finally:
        shared.unpersist()
    spark = weighted.sparkSession
    return [PipelineModel(stages=[*features.stages, _without_summary(head, spark)]) for head in heads]


def train_text_classifier(
    weighted: DataFrame,
    num_features: int = 1 << 18,
    max_iter: int = 20,
    reg_param: float = 0.01,
) -> PipelineModel:
    """One weighted logistic regression on texts."""
    return train_text_classifiers(weighted, [reg_param], num_features, max_iter)[0]


def _positive_probability(column: str = "probability") -> Column:
    return F.element_at(vector_to_array(column), 2)


def score_text(model: PipelineModel, examples: DataFrame, model_id: str = "text") -> DataFrame:
    """(id, model_id, score) of a fitted text classifier."""
    rows = _without_null_texts(examples.select("id", "text"))
    return model.transform(rows).select(
        "id", F.lit(model_id).alias("model_id"), _positive_probability().alias("score")
    )


def train_embedding_head(
    embeddings: DataFrame, vector: str = "embedding", label: str = "label", max_iter: int = 20
) -> LogisticRegressionModel:
    """A linear head on given document vectors: one multinomial fit for all classes."""
    rows = embeddings.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    model = LogisticRegression(maxIter=max_iter, regParam=0.01, aggregationDepth=3).fit(rows)
    return _without_summary(model, embeddings.sparkSession)


def score_batches(
    df: DataFrame,
    load_scorer: Callable[[], Callable[[pd.DataFrame], Sequence[float]]],
    key: str = "id",
) -> DataFrame:
    """(key, score) from a Python scorer, in Arrow batches, in no particular order.

    ``load_scorer`` runs once per task and returns a function from a batch to one score
    per row. Select only the columns that the scorer reads before calling this.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "score": scorer(batch)})

    return df.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double")


# A term with at least 1/HOT_TERMS of all occurrences is hot: there are at most
# HOT_TERMS of them in any collection, so their weights, some 100 bytes each, can be
# broadcast. In natural language they are nearly all occurrences.
HOT_TERMS = 1_000_000


@dataclass(frozen=True)
class NaiveBayes:
    """``weights`` is (term, log_odds, hot); ``prior`` a one-row table with the log-odds."""

    weights: DataFrame
    prior: DataFrame


def train_naive_bayes(
    tokens: DataFrame,
    alpha: float = 1.0,
    examples: DataFrame | None = None,
    hot_terms: int | None = None,
) -> NaiveBayes:
    """Multinomial naive Bayes: smoothed log-odds per term from one pass over the texts.

    ``hot_terms`` bounds how many terms are broadcast when documents are scored; without it,
    ``HOT_TERMS``.
    """
    hot_terms = HOT_TERMS if hot_terms is None else hot_terms
    counts = settle(class_term_counts(tokens))
    totals = counts.agg(
        F.struct(
            F.sum("n_pos").alias("pos"), F.sum("n_neg").alias("neg"), F.count("*").alias("terms")
        )
    ).scalar()
    pos = (F.col("n_pos") + alpha) / (totals["pos"] + totals["terms"] * F.lit(alpha))
    neg = (F.col("n_neg") + alpha) / (totals["neg"] + totals["terms"] * F.lit(alpha))
    share = (F.col("n_pos") + F.col("n_neg")) * F.lit(hot_terms)
    weights = counts.select(
        "term",
        (F.log(pos) - F.log(neg)).alias("log_odds"),
        (share >= totals["pos"] + totals["neg"]).alias("hot"),
    )
    odds = (F.col("size_pos") + F.lit(alpha)) / (F.col("size_neg") + F.lit(alpha))
    prior = class_sizes(tokens if examples is None else examples).select(F.log(odds).alias("log_odds"))
    return NaiveBayes(weights, prior)


def naive_bayes_scores(model: NaiveBayes, documents: DataFrame, model_id: str = "nb") -> DataFrame:
    """(id, model_id, score, log_odds) of tokenised documents.

    Terms not seen in training are ignored. Texts are exploded once: hot terms, which are most
    occurrences, meet their weight in a broadcast join and are summed per document, rare
    ones are counted per document, in one aggregation. Only the rare rest is shuffled by
    term, where no key is hot: a document's sum of hot terms is a row with a key of its own
    there. That join is told to shuffle: size estimates ignore that the tokens of a text are
    many rows, and would broadcast them.
    """
    weights = model.weights
    hot = F.broadcast(weights.filter("hot").select("term", F.col("log_odds").alias("_hot")))
    cold = weights.filter(~F.col("hot")).select("term", F.col("log_odds").alias("_cold"))
    # The outer form keeps documents without a term.
    occurrences = documents.select("id", F.explode_outer("tokens").alias("term"))
    rare = F.when(F.col("_hot").isNull(), F.col("term"))
    counted = (
        occurrences.join(hot, "term", "left")
        .groupBy("id", rare.alias("_rare"))
        .agg(F.sum("_hot").alias("_odds"), F.count("*").alias("_n"))
    )
    own_key = F.coalesce("_rare", F.concat(F.lit("\0"), F.xxhash64("id").cast("string")))
    joined = counted.withColumn("term", own_key).join(cold.hint("merge"), "term", "left")
    odds = F.coalesce("_odds", F.lit(0.0)) + F.col("_n") * F.coalesce("_cold", F.lit(0.0))
    prior = model.prior.scalar()
    summed = joined.groupBy("id").agg((F.sum(odds) + prior).alias("log_odds"))
    return summed.select(
        "id", F.lit(model_id).alias("model_id"), sigmoid("log_odds").alias("score"), "log_odds"
    )


def predict_split(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """Long scores of several models to (id, score, pred): mean, then threshold.

    ``threshold`` is the one-row table of ``read_threshold`` or ``threshold_sweep``.
    """
    cut = threshold.select("threshold").scalar()
    return ensemble_mean(scores).withColumn("pred", decide("score", cut))
