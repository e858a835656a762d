"""The work flow from raw files to error tables, composed of the operators.

prepare -> verify -> profile -> train -> predict -> evaluate, write_prediction_file. Each step reads tables and
returns or writes tables; splits should be stored once and read back between steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions import (
    binarise,
    inject_keyword,
    n_tokens,
    n_ws_tokens,
    parse_label,
    word_tokens,
)
from textlens.operators import lexical, metrics, modelling, profile, quality, rebalance, selection, training
from textlens.operators.gradient_fit import Head, Heads
from textlens.operators.joins import CANONICAL, attach_text, select_columns
from textlens.operators.training import LinearText
from textlens.schemas import LABEL_NAMES
from textlens.sources import (
    read_corpus_tsv,
    read_history,
    read_labels_csv,
    read_predictions,
    read_scores,
    read_split,
    read_threshold,
    read_unlabelled_tsv,
    write_history,
    write_predictions,
    write_scores,
    write_split,
    write_threshold,
)
from textlens.session import settle


def prepare(
    spark: SparkSession,
    corpus_path: str,
    label_paths: Mapping[str, str],
    unlabelled_path: str | None,
    out_dir: str,
    format: str = "parquet",
    skip: int = 4,
) -> None:
    """Write one split per label file, in its row order, and the unlabelled split."""
    corpus = read_corpus_tsv(spark, corpus_path, skip=skip)
    for name, path in label_paths.items():
        labels = read_labels_csv(spark, path, row_ids=True)
        split = attach_text(labels, corpus).select("row_id", *CANONICAL)
        write_split(split, f"{out_dir}/{name}", format, row="row_id")
    if unlabelled_path is not None:
        test = read_unlabelled_tsv(spark, unlabelled_path, row_ids=True)
        test = test.select("row_id", *select_columns(test).columns)
        write_split(test, f"{out_dir}/test", format, row="row_id")


def verify(
    spark: SparkSession,
    corpus_path: str,
    label_paths: Mapping[str, str],
    unlabelled_path: str | None,
    out_dir: str,
    format: str = "parquet",
    skip: int = 4,
    width: int = 7,
) -> DataFrame:
    """One report over the written splits: (check, expected, actual, ok)."""
    corpus = read_corpus_tsv(spark, corpus_path, skip=skip)
    checks = [quality.check_unique_key(corpus, "id", "corpus: unique key")]
    for name, path in label_paths.items():
        labels = read_labels_csv(spark, path)
        split = read_split(spark, f"{out_dir}/{name}", format)
        cells = quality.check_content(split, labels, corpus, "id", CANONICAL[1:])
        checks += [
            quality.check_row_count(labels, split, f"{name}: row count"),
            quality.check_columns(split, CANONICAL, f"{name}: columns"),
            quality.content_check(cells, f"{name}: content"),
            quality.check_missing(labels, corpus, name=f"{name}: missing text"),
            quality.check_label_format(labels, width, name=f"{name}: label format"),
        ]
    if unlabelled_path is not None:
        raw = read_unlabelled_tsv(spark, unlabelled_path)
        test = read_split(spark, f"{out_dir}/test", format, labelled=False)
        checks += [
            quality.check_row_count(raw, test, "test: row count"),
            quality.check_tables_equal(raw, test, "id", CANONICAL[1:5], "test: content"),
        ]
    return quality.quality_report(*checks)


def labelled(split: DataFrame, width: int = 7) -> DataFrame:
    """A split with its label vector and binary target."""
    vector = parse_label("label", width)
    return split.withColumn("label_vec", vector).withColumn("y", binarise("label_vec"))


def tokenised(examples: DataFrame) -> DataFrame:
    """(id, y, tokens, n_tokens): worth storing when several reports read it."""
    return examples.select("id", "y", word_tokens("text").alias("tokens")).withColumn(
        "n_tokens", n_tokens("tokens")
    )


def profile_tables(
    examples: DataFrame, tokens: DataFrame, stop_words: Sequence[str]
) -> dict[str, DataFrame]:
    """Every table of the collection's profile."""
    return {
        "class_distribution": profile.class_distribution(examples),
        "label_frequency": profile.label_frequency(examples),
        "labels_per_row_histogram": profile.labels_per_row_histogram(examples),
        "labels_per_row_stats": profile.labels_per_row_stats(examples),
        "token_length_stats": profile.token_length_stats(tokens),
        "length_histogram": profile.length_histogram(tokens),
        "length_coverage": profile.length_coverage(tokens),
        "vocabulary_size": profile.vocabulary_size(tokens),
        "bigrams": lexical.ngram_table_side_by_side(tokens, 2),
        "trigrams": lexical.ngram_table_side_by_side(tokens, 3),
        "trigram_enrichment": lexical.ngram_enrichment(tokens),
        "stop_word_density": lexical.stop_word_density(tokens, stop_words),
        "content_words": lexical.top_content_words(tokens, stop_words),
        "distinctive_words": lexical.distinctive_words(tokens, stop_words),
        "term_weights": lexical.term_weights(tokens, stop_words),
    }


def model_input(split: DataFrame) -> DataFrame:
    """The split with "[keyword] text" as its text, which models train on and score."""
    return split.withColumn("text", inject_keyword("keyword", "text"))


@dataclass(frozen=True)
class Training:
    """The chosen model, the metrics of every epoch of every run, and the threshold for the dev
    split; with label heads, also these and their epochs."""

    model: LinearText
    history: DataFrame
    dev_scores: DataFrame
    threshold: DataFrame
    label_model: LinearText | None = None
    label_history: DataFrame | None = None


def train(
    train_split: DataFrame,
    dev_split: DataFrame,
    reg_params: Sequence[float] = (0.001, 0.01, 0.1),
    pos_ratio: float = 0.33,
    n_aug: int = 0,
    drop_prob: float = 0.10,
    seed: int = 42,
    num_features: int = 1 << 18,
    max_iter: int = 20,
    gamma: float = 2.0,
    epochs: int = 1,
    patience: int = 5,
    draws: bool = False,
    width: int = 0,
    label_reg: float = 0.01,
    folder: str | None = None,
) -> Training:
    """Fit one classifier per regularisation on focal loss; keep the one with the best dev F1.

    Positives are augmented; classes are balanced by row weights, or with ``draws`` by as
    many draws with replacement as there are rows (keys must then be unique). With a
    ``width``, a head for each label is fitted too. All runs and heads share the features and
    every scan. An epoch is ``max_iter`` steps; after each, dev is scored, a run keeps its best
    epoch and ends by the early-stop rule. ``folder``, in shared storage, lets a killed
    training go on behind its last epoch. The threshold is swept on the winner's dev scores.
    """
    labels = ["label_vec"] if width else []
    rows = model_input(train_split).select("id", "y", "text", *labels)
    if n_aug > 0:
        copies = rebalance.augment_word_deletion(rows, n_aug, drop_prob, seed)
        rows = rebalance.append_augmented(rows, copies)
    if draws:
        copy = F.col("copy") if n_aug > 0 else F.lit(0)
        rows = rows.withColumn("draw_key", F.xxhash64("id", copy))
        keys = rows.select(F.col("draw_key").alias("id"), "y")
        drawn = rebalance.draw_balanced(keys, pos_ratio=pos_ratio, seed=seed).withColumnRenamed("id", "draw_key")
        weighted = rows.join(drawn.select("draw_key", F.col("n_draws").alias("weight")), "draw_key")
    else:
        weighted = rebalance.class_weights(rows, pos_ratio)
    vector = "label_vec" if width else None
    features = training.fit_features(rows, num_features)
    runs = [Head(f"run-{i}", 0, gamma, reg) for i, reg in enumerate(reg_params)]
    heads = [Head(f"label-{k}", 1 + k, 0.0, label_reg) for k in range(width)]
    dev_rows = model_input(dev_split).select("id", "y", "text", *labels)
    result = training.train_epochs(
        training.text_design(features, weighted, vector, "weight"),
        training.text_design(features, dev_rows, vector),
        Heads(tuple(runs + heads), num_features),
        epochs,
        max_iter,
        patience,
        folder,
    )
    names = tuple(h.name for h in runs + heads)
    fitted = LinearText(features, np.stack(result.points), names)
    history = result.history.where(F.col("run_id").startswith("run-"))
    best = selection.search_runs(history.withColumnRenamed("dev_f1", "f1"), patience).first()["run_id"]
    model = fitted.head(best)
    chosen = settle(model.scores(model_input(dev_split), best).join(dev_split.select("id", "y"), "id"))
    return Training(
        model,
        history,
        chosen,
        metrics.threshold_sweep(chosen),
        replace(fitted, weights=fitted.weights[len(runs) :], names=names[len(runs) :]) if width else None,
        result.history.where(F.col("run_id").startswith("label-")) if width else None,
    )


def write_training(result: Training, out_dir: str) -> None:
    """History, dev scores and threshold, where ``read_training`` and ``search_runs`` find them."""
    out_dir = out_dir.rstrip("/")
    write_history(result.history, f"{out_dir}/history")
    write_scores(result.dev_scores, f"{out_dir}/dev_scores")
    write_threshold(result.threshold.select("threshold"), f"{out_dir}/threshold")


def read_training(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """What ``write_training`` wrote, as tables."""
    out_dir = out_dir.rstrip("/")
    return {
        "history": read_history(spark, f"{out_dir}/history"),
        "dev_scores": read_scores(spark, f"{out_dir}/dev_scores"),
        "threshold": read_threshold(spark, f"{out_dir}/threshold"),
    }


def predict(
    models: Sequence[LinearText | PipelineModel], split: DataFrame, threshold: DataFrame
) -> DataFrame:
    """(id, score, pred): mean score of the models, cut at the threshold.

    A split read with ``row_ids`` gives (row_id, score, pred) instead, one row for each of its
    rows, also where keys are repeated or null. Settled, so that the tables made from
    it do not score the split again.
    """
    rows = model_input(split)
    by_row = "row_id" in split.columns
    if by_row:
        rows = rows.select(F.col("row_id").alias("id"), "text")
    scores = [
        m.scores(rows, f"model-{i}") if isinstance(m, LinearText) else modelling.score_text(m, rows, f"model-{i}")
        for i, m in enumerate(models)
    ]
    cut = modelling.predict_split(reduce(lambda a, b: a.unionByName(b), scores), threshold)
    return settle(cut.withColumnRenamed("id", "row_id") if by_row else cut)


def write_prediction_file(
    predictions: DataFrame, split: DataFrame, path: str, expected_rows: int | None = None
) -> DataFrame:
    """One 0/1 per line, in the row order of a split read with ``row_ids``.

    There are as many lines as rows of the split; a row without a prediction is an error.
    Predictions by ``row_id`` are joined by it, others by ``id``, which must then be unique.
    Returns the check (check, expected, actual, ok) of the lines that were written against
    the rows of the split, or against ``expected_rows``.
    """
    key = "row_id" if "row_id" in predictions.columns else "id"
    joined = split.select(*dict.fromkeys(("row_id", key))).join(predictions.select(key, "pred"), key, "left")
    message = F.concat(F.lit("no prediction for row "), F.col("row_id").cast("string"))
    pred = F.when(F.col("pred").isNull(), F.raise_error(message).cast("int")).otherwise(F.col("pred"))
    write_predictions(joined.select("row_id", pred.alias("pred")), path)
    lines = read_predictions(split.sparkSession, path)
    if expected_rows is not None:
        return quality.check_expected_rows(lines, expected_rows, "prediction lines")
    return quality.check_row_count(split, lines, "prediction lines")


def evaluate_labels(
    label_model: LinearText, examples: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """Precision, recall and F1 of every label head, and their averages."""
    scores = label_model.label_scores(model_input(examples))
    decided = F.transform("label_scores", lambda s: (s >= threshold).cast("double"))
    return metrics.multilabel_metrics(
        examples.select("id", "label_vec").join(scores.select("id", decided.alias("pred_vec")), "id")
    )


def evaluate(
    examples: DataFrame, predictions: DataFrame, label_names: Sequence[str] = LABEL_NAMES
) -> dict[str, DataFrame]:
    """Every error table of (id, score, pred) against the labelled examples."""
    scored = examples.join(predictions, "id").withColumn("n_ws_tokens", n_ws_tokens("text"))
    by_group = metrics.errors_by_group(scored)
    by_label = metrics.errors_by_label(scored, label_names)
    return {
        "summary": metrics.evaluation_summary(scored),
        "classification_report": metrics.classification_report(scored),
        "confusion_matrix": metrics.confusion_matrix(scored),
        "errors_by_group": metrics.sort_by_metric(by_group, "fn", "keyword"),
        "errors_by_label": metrics.sort_by_metric(by_label, "miss_rate", "label"),
        "worst_groups": metrics.worst_groups(by_group, by_label),
        "false_positives": metrics.hardest_false_positives(scored),
        "false_negatives": metrics.hardest_false_negatives(scored),
        "length_by_quadrant": metrics.length_by_quadrant(scored),
        "pr_curve": metrics.pr_curve(scored),
        "score_histogram": metrics.score_histogram(scored),
        "threshold_grid": metrics.threshold_grid(scored),
    }
