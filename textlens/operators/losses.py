"""Reductions of the per-row losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.scoring import bce_with_logits, focal_loss


def reduce_focal_loss(
    rows: DataFrame, gamma: float = 2.0, reduction: str = "mean"
) -> DataFrame:
    """Focal loss of (logit, y) rows: 'none' keeps a row each, 'mean' and 'sum' reduce."""
    loss = focal_loss("logit", F.col("y").cast("double"), gamma)
    if reduction == "none":
        return rows.withColumn("focal_loss", loss)
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    total = F.avg(loss) if reduction == "mean" else F.sum(loss)
    return rows.agg(total.alias("focal_loss"))


def combined_loss(
    rows: DataFrame,
    gamma: float = 2.0,
    weight: float = 0.3,
    logits: str = "label_logits",
    vector: str = "label_vec",
) -> DataFrame:
    """Mean focal loss plus ``weight`` times the mean cross-entropy over all label cells.

    The label cells of a row are summed inside the row, so one aggregation gives both
    parts.
    """
    per_cell = F.transform(
        F.arrays_zip(F.col(logits).alias("x"), F.col(vector).alias("t")),
        lambda cell: bce_with_logits(cell["x"], cell["t"]),
    )
    per_row = F.aggregate(per_cell, F.lit(0.0), lambda total, x: total + x)
    parts = rows.select(
        focal_loss("logit", F.col("y").cast("double"), gamma).alias("_focal"),
        per_row.alias("_labels"),
        F.size(vector).alias("_width"),
    ).agg(
        F.avg("_focal").alias("focal_loss"),
        (F.sum("_labels") / F.sum("_width")).alias("label_loss"),
    )
    return parts.withColumn(
        "combined_loss", F.col("focal_loss") + F.lit(weight) * F.col("label_loss")
    )
