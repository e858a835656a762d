"""Choosing a checkpoint or run from per-epoch metrics: (run_id, epoch, f1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.scoring import f1_from_counts
from textlens.operators.ranking import first_rows


def history_from_scores(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """F1 per (run_id, epoch) of a long table (run_id, epoch, y, score)."""
    hit = F.col("score") >= threshold
    positive = F.col("y") == 1
    counts = scores.groupBy("run_id", "epoch").agg(
        F.count_if(positive & hit).alias("tp"),
        F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"),
    )
    return counts.select("run_id", "epoch", f1_from_counts("tp", "fp", "fn").alias("f1"))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """Flags the epochs that beat every earlier one (strictly, from 0), and the best.

    A run has few epochs, so a window per run is small.
    """
    in_order = Window.partitionBy("run_id").orderBy("epoch")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.coalesce(F.max("f1").over(earlier), F.lit(0.0)), F.lit(0.0))
    flagged = history.withColumn("improved", F.col("f1") > before)
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(Window.partitionBy("run_id"))
    return flagged.withColumn("is_best", F.coalesce(F.col("epoch") == last, F.lit(False)))


def with_patience(history: DataFrame, patience: int = 5) -> DataFrame:
    """Adds the streak without improvement, and whether the epoch is run at all.

    Training stops at the first epoch whose streak reaches ``patience``; later epochs
    have ``ran`` false.
    """
    in_order = Window.partitionBy("run_id").orderBy("epoch")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("run_id")
    numbered = best_checkpoint(history).withColumn("_i", F.row_number().over(in_order))
    last_gain = F.coalesce(F.max(F.when(F.col("improved"), F.col("_i"))).over(so_far), F.lit(0))
    streaks = numbered.withColumn("streak", F.col("_i") - last_gain)
    stop = F.min(F.when(F.col("streak") >= patience, F.col("_i"))).over(whole)
    return (
        streaks.withColumn("_stop", stop)
        .withColumn("ran", F.coalesce(F.col("_i") <= F.col("_stop"), F.lit(True)))
        .drop("_i", "_stop", "is_best")
    )


def early_stop(history: DataFrame, patience: int = 5) -> DataFrame:
    """Per run: the epoch training stops at (null if it runs to the end) and the best one."""
    epochs = with_patience(history, patience)
    return (
        epochs.filter("ran")
        .groupBy("run_id")
        .agg(
            F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).alias("stop_epoch"),
            F.max("epoch").alias("last_epoch"),
            F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
            F.coalesce(F.max(F.when(F.col("improved"), F.col("f1"))), F.lit(0.0)).alias("best_f1"),
        )
    )


def search_runs(history: DataFrame, patience: int = 5) -> DataFrame:
    """The run whose best epoch has the highest F1 (ties: smallest run id)."""
    runs = early_stop(history, patience)
    best = first_rows(runs, 1, [F.col("best_f1").desc(), F.col("run_id").asc()])
    return best.select("run_id", "best_epoch", "best_f1")
