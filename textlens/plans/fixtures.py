"""The given tables in the roles of the engine's inputs.

documents is the corpus, labels the label file with the vector (low quality, toxic);
scores are a surrogate: a hash of the id, shifted for positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions import (
    binarise,
    decide,
    n_tokens,
    n_ws_tokens,
    seeded_uniform,
    word_tokens,
)
from textlens.operators.joins import attach_text, spread

LABEL_NAMES = ("low_quality", "toxic")
WIDTH = 2

# Frequent function words of the four languages of the documents (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec des du en et la le les pour que qui sur un une "
    "das dem den der die ein ist mit sich und von zu "
    "con de del el las los no por se su"
).split()


# Explicit, so that reading a table runs no job to find its schema.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("keyword"),
        F.col("lang").alias("country"),
        "text",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label_vec, y) without the texts; enough for whatever reads labels only."""
    vector = F.array(
        (F.lit(1) - F.col("quality")).cast("double"), F.col("toxic").cast("double")
    )
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), vector.alias("label_vec")
    )
    return rows.withColumn("y", binarise("label_vec"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their texts: (id, label_vec, y, keyword, country, text)."""
    documents = corpus(spark, sf_dir)
    return spread(attach_text(labels(spark, sf_dir), documents), documents)


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus(spark, sf_dir)
    return spread(documents, documents)


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus(spark, sf_dir)
    rest = documents.join(labels(spark, sf_dir).select("id"), "id", "left_anti")
    return spread(rest, documents)


def with_tokens(texts: DataFrame) -> DataFrame:
    return texts.withColumn("tokens", word_tokens("text")).withColumn(
        "n_tokens", n_tokens("tokens")
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenised examples."""
    return with_tokens(examples(spark, sf_dir).select("id", "y", "text"))


def surrogate_score(*parts) -> Column:
    u = seeded_uniform(*parts, F.col("id"))
    return F.round(F.lit(0.65) * u + F.lit(0.35) * F.col("y"), 6)


def scores_long(rows: DataFrame, models: int = 3) -> DataFrame:
    """(id, y, model_id, score): one row per surrogate model."""
    model = F.explode(F.sequence(F.lit(1), F.lit(models))).alias("_m")
    return rows.select("id", "y", model).select(
        "id",
        "y",
        F.col("_m").cast("string").alias("model_id"),
        surrogate_score(F.col("_m")).alias("score"),
    )


def scored(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the mean surrogate score and the decision to labelled rows."""
    total = surrogate_score(1) + surrogate_score(2) + surrogate_score(3)
    return rows.withColumn("score", F.round(total / 3, 6)).withColumn(
        "pred", decide("score", threshold)
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(labels(spark, sf_dir))


def scored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(examples(spark, sf_dir)).withColumn("n_ws_tokens", n_ws_tokens("text"))


def logits(rows: DataFrame) -> DataFrame:
    s = F.greatest(F.least(F.col("score"), F.lit(0.999999)), F.lit(0.000001))
    return rows.withColumn("logit", F.log(s / (F.lit(1.0) - s)))


def run_history_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, y, score): three surrogate runs of ten epochs."""
    run = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("run_id")
    epoch = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("epoch")
    rows = labels(spark, sf_dir).select("id", "y", run).select("*", epoch)
    return rows.withColumn("score", surrogate_score(F.col("run_id"), F.col("epoch")))
