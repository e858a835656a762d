"""The corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes the documents that the one before it kept and returns documents; the last
returns packed pieces. Between stages the documents are a Parquet table in the shared folder.
Every stage keeps null ids and texts and repeated rows as rows of their own unless it says
otherwise, gives an empty table for an empty one, and passes on the columns of `COLUMNS` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import store
from textlens.llm.jaccard_join import jaccard_components
from textlens.llm.mixing import mix_sources, shuffled_shards, with_size
from textlens.llm.packing import pack_documents
from textlens.llm.pii_spans import redact, train_span_classifier, with_candidates, with_spans
from textlens.llm.quality_mil import score_quality, train_quality
from textlens.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose probability of good quality is below this go.
LEAST_QUALITY = 0.3
#: Rows of labels from which the quality model is fitted (`train_quality`'s bound).
QUALITY_SAMPLE = 10_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels of
    the stage's own input. Rows with a null or repeated id are judged by their own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels, sample_rows=QUALITY_SAMPLE)
    named = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return score_quality(named, model, id_col="row").where(F.col("score") >= LEAST_QUALITY).select("id.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Documents
    without words, or with a null id, are in no group and stay; of rows that repeat the kept
    id all stay."""
    groups = jaccard_components(docs)
    gone = store(groups.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become marks; `n_chars` is the new length. No document goes."""
    found = store(with_candidates(docs.select(*COLUMNS)), "candidates")
    weights = train_span_classifier(found)
    hidden = with_spans(found, weights).withColumn("text", redact(F.col("text"), F.col("spans")))
    return hidden.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its share of the words: documents are repeated up to three times or
    left out. Rows are in their output shard, shuffled."""
    mixed = mix_sources(with_size(docs.select(*COLUMNS)))
    return shuffled_shards(mixed).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", hide_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, the span model and the draws are beyond SQL; tests hold each stage against
#: a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
