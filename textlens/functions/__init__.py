"""Column expressions: all built-in, all inside the JVM."""

from textlens.functions.hashing import hash_key, seeded_uniform, uniform_exceeds
from textlens.functions.labels import (
    binarise,
    label_is_bad,
    labels_per_row,
    parse_label,
    unlabelled_targets,
)
from textlens.functions.scoring import (
    bce_with_logits,
    decide,
    f1_from_counts,
    focal_loss,
    percent_of,
    quadrant,
    safe_ratio,
    sigmoid,
)
from textlens.functions.text import (
    inject_keyword,
    is_missing,
    n_tokens,
    n_ws_tokens,
    ngrams,
    preview,
    word_tokens,
    ws_tokens,
)

__all__ = [
    "bce_with_logits",
    "binarise",
    "decide",
    "f1_from_counts",
    "focal_loss",
    "hash_key",
    "inject_keyword",
    "is_missing",
    "label_is_bad",
    "labels_per_row",
    "n_tokens",
    "n_ws_tokens",
    "ngrams",
    "parse_label",
    "percent_of",
    "preview",
    "quadrant",
    "safe_ratio",
    "seeded_uniform",
    "sigmoid",
    "uniform_exceeds",
    "unlabelled_targets",
    "word_tokens",
    "ws_tokens",
]
