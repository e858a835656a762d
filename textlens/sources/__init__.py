"""Readers and writers of corpora, labels, splits, predictions, scores and reports."""

from textlens.sources.readers import (
    number_rows,
    read_corpus_tsv,
    read_history,
    read_labels_csv,
    read_predictions,
    read_scores,
    read_split,
    read_threshold,
    read_unlabelled_tsv,
)
from textlens.sources.writers import (
    write_history,
    write_predictions,
    write_report_tables,
    write_scores,
    write_split,
    write_threshold,
)

__all__ = [
    "number_rows",
    "read_corpus_tsv",
    "read_history",
    "read_labels_csv",
    "read_predictions",
    "read_scores",
    "read_split",
    "read_threshold",
    "read_unlabelled_tsv",
    "write_history",
    "write_predictions",
    "write_report_tables",
    "write_scores",
    "write_split",
    "write_threshold",
]
