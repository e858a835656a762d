"""Label vectors: parsing, binarising, sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR = "array<double>"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parsed(label) -> Column:
    """The bracketed list as doubles, or NULL when it is not a list of numbers."""
    label = _column(label).cast("string")
    vector = F.from_json(label, VECTOR)
    # from_json stops at the closing bracket, so trailing junk needs its own test.
    whole = label.rlike(r"^\s*\[.*\]\s*$")
    return F.when(whole & ~F.exists(vector, lambda x: x.isNull()), vector)


def parse_label(label, width: int = 7) -> Column:
    """'[1, 0, 0, 1, 0, 0, 0]' as an array of doubles; zeros when it does not parse."""
    return F.coalesce(_parsed(label), F.array_repeat(F.lit(0.0), width))


def label_is_bad(label, width: int = 7) -> Column:
    """True when the label does not parse or has another length than ``width``."""
    vector = _parsed(label)
    return F.coalesce(F.size(vector) != width, F.lit(True)) | vector.isNull()


def labels_per_row(vector) -> Column:
    return F.aggregate(_column(vector), F.lit(0.0), lambda total, x: total + x)


def binarise(vector) -> Column:
    """1 when any label is set, else 0."""
    return (labels_per_row(vector) > 0).cast("int")


def unlabelled_targets(width: int = 7) -> tuple[Column, Column]:
    """The -1 sentinels a row without labels carries at the export edge."""
    return F.array_repeat(F.lit(-1.0), width), F.lit(-1)
