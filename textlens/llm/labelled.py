"""Labelled rows that models may learn from: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import held_out, store, uniform

#: Passages that stand for a text that is too long for a sample.
PASSAGES = 200


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id",
    text_col: str = "text", longest: int = 2_000_000, balanced: bool = False,
) -> DataFrame:
    """`text, y` of about `rows` labelled documents, drawn by a hash of the id.

    Rows of the held-out fifth and those with a null id or label are never drawn. With
    `balanced`, each label gets half of the rows, or all it has. A repeated id counts once with
    each of its labels, and with one of its texts, the one with the smallest hash. Of a text
    longer than `longest` characters, passages spread evenly over it stand for it, so that no
    document is left out for its length and the sample has a bound.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))
    )
    usable = usable.distinct()
    by_label = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if not by_label:
        share = F.lit(0.0)
    elif balanced:
        n = {y: min(1.0, rows / 2 / c) for y, c in by_label.items()}
        share = F.when(F.col("y") == 1, n.get(1, 0.0)).otherwise(n.get(0, 0.0))
    else:
        share = F.lit(min(1.0, rows / sum(by_label.values())))
    drawn = store(usable.where(uniform(F.lit("sample"), "id") < share), "sample-ids")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = texts.withColumn("text", _spread(F.col("text"), longest)).join(drawn, "id")
    chosen = short.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return chosen.select("first.text", "y")


def _spread(text: Column, longest: int) -> Column:
    """A text of at most `longest` characters as it is; of a longer one, every so many passages."""
    size = max(1, longest // PASSAGES)
    every = F.ceil(F.length(text) / longest).cast("int")
    passages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) > longest, F.array_join(F.filter(passages, lambda _, i: i % every == 0), " ")).otherwise(text)
