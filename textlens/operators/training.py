"""Training text models on the focal and label objective: joint heads, epochs, cross-fitting.

All models of a call are fitted in the same scans of one stored design table, whatever their
number: regularisations, label heads and folds cost computing, not passes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.scoring import f1_from_counts, safe_ratio, sigmoid
from textlens.operators import selection
from textlens.operators.gradient_fit import (
    Head, Heads, Lbfgs, Shared, advance, design, design_rows, features_of, fit, hashed_fold, margins, packed, target_margins,
)
from textlens.operators.modelling import text_features

HISTORY = "run_id string, epoch bigint, loss double, dev_f1 double, dev_p double, dev_r double"


def _texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def fit_features(rows: DataFrame, num_features: int = 1 << 18) -> PipelineModel:
    return Pipeline(stages=text_features(num_features)).fit(_texts(rows))


@dataclass(frozen=True)
class LinearText:
    """Heads over text features: a row of weights each, the intercept last."""

    features: PipelineModel
    weights: np.ndarray
    names: tuple[str, ...]

    def logits(self, rows: DataFrame, *keep: str) -> DataFrame:
        """`id`, the columns to keep and `margins`, one logit a head, of (id, text) rows."""
        vectors = self.features.transform(_texts(rows.select("id", "text", *keep)))
        return margins(vectors.select("id", *keep, *features_of("features")), self.weights, *keep)

    def head(self, name: str) -> LinearText:
        return replace(self, weights=self.weights[[self.names.index(name)]], names=(name,))

    def scores(self, rows: DataFrame, model_id: str = "text") -> DataFrame:
        """(id, model_id, score) of the first head."""
        return self.logits(rows).select("id", F.lit(model_id).alias("model_id"), sigmoid(F.col("margins")[0]).alias("score"))

    def label_scores(self, rows: DataFrame) -> DataFrame:
        """(id, label_scores): the score of every head, in order."""
        scores = F.transform("margins", lambda z: sigmoid(z))
        return self.logits(rows).select("id", scores.alias("label_scores"))


def targets_of(y: str = "y", vector: str | None = "label_vec"):
    """The targets of the heads: the binary one, then the labels (1 for a positive number)."""
    binary = F.array(F.col(y).cast("double"))
    if vector is None:
        return binary
    return F.concat(binary, F.transform(vector, lambda v: (v > 0).cast("double")))


def text_design(
    features: PipelineModel, rows: DataFrame, vector: str | None = "label_vec", weight: str | None = None, fold=None
) -> DataFrame:
    """The design table of labelled texts (id, text, y, label vector)."""
    return design(
        features.transform(_texts(rows)), "features", targets_of(vector=vector), F.col(weight) if weight else None, fold
    )


def text_blocks(
    features: PipelineModel, rows: DataFrame, vector: str | None = "label_vec", weight: str | None = None, fold=None
) -> DataFrame:
    """The same rows packed for fits, without a stored table of rows."""
    return packed(
        design_rows(
            features.transform(_texts(rows)), "features", targets_of(vector=vector), F.col(weight) if weight else None, fold
        )
    )


# --- the focal and label objective ---------------------------------------------------


def train_focal(
    rows: DataFrame,
    width: int,
    gamma: float = 2.0,
    label_weight: float = 0.3,
    rank: int = 0,
    reg: float = 0.01,
    num_features: int = 1 << 18,
    steps: int = 40,
    weight: str | None = None,
    seed: int = 42,
) -> tuple[LinearText, list[float]]:
    """A model of (id, text, y, label_vec) rows on mean focal loss plus `label_weight` times the
    mean cross-entropy of `width` labels, and the objective after every step.

    With a `rank` the binary head and the label heads share that many learned directions, so
    that the labels shape the binary head. With rank 0 heads share nothing: each minimises its own part,
    which minimises the sum, and the label weight only changes the figure that is reported.
    The first head of the result is the binary one. Rows without y or with a missing label
    are left out; an empty table gives the starting model.
    """
    features = fit_features(rows, num_features)
    table = text_blocks(features, rows, weight=weight)
    names = ("y", *[f"label_{k}" for k in range(width)])
    if rank:
        objective = Shared(num_features, width, rank, gamma, label_weight, reg, seed)
        (state,) = fit(table, objective, steps)
        return LinearText(features, objective.weights([_point(state)]), names), state.losses
    heads = [Head(names[0], 0, gamma, reg)] + [Head(n, k, 0.0, reg) for k, n in enumerate(names) if k]
    objective = Heads(tuple(heads), num_features)
    states = fit(table, objective, steps)
    share = [1.0] + [label_weight / max(1, width)] * width
    losses = [
        sum(s * (state.losses[min(i, len(state.losses) - 1)] if state.losses else 0.0) for s, state in zip(share, states))
        for i in range(max((len(s.losses) for s in states), default=0))
    ]
    return LinearText(features, objective.weights([_point(s) for s in states]), names), losses


def train_svm(
    rows: DataFrame,
    regs: Sequence[float] = (0.001,),
    num_features: int = 1 << 18,
    steps: int = 100,
    gap: float = 1e-3,
    weight: str | None = None,
) -> tuple[LinearText, list[float]]:
    """Linear support vector machines (squared hinge) of (id, text, y) rows, one for each
    regularisation, in the same scans, and the duality gap that each ended with."""
    features = fit_features(rows, num_features)
    table = text_blocks(features, rows, None, weight)
    names = tuple(f"svm-{i}" for i in range(len(regs)))
    objective = Heads(tuple(Head(n, 0, reg=r, margin=True, gap=gap) for n, r in zip(names, regs)), num_features)
    states = fit(table, objective, steps)
    return LinearText(features, objective.weights([_point(s) for s in states]), names), [s.gap for s in states]


def train_label_heads(
    rows: DataFrame,
    width: int,
    num_features: int = 1 << 18,
    steps: int = 20,
    reg: float = 0.01,
    weight: str | None = None,
) -> LinearText:
    """A logistic regression for each of `width` labels of (id, text, label_vec) rows, all in the
    same scans: their number does not depend on the number of labels."""
    features = fit_features(rows, num_features)
    table = text_blocks(features, rows.withColumn("y", F.lit(0)), weight=weight)
    names = tuple(f"label_{k}" for k in range(width))
    objective = Heads(tuple(Head(n, 1 + k, 0.0, reg) for k, n in enumerate(names)), num_features)
    states = fit(table, objective, steps)
    return LinearText(features, objective.weights([_point(s) for s in states]), names)


def _point(state: Lbfgs) -> np.ndarray:
    return state.best if len(state.best) else state.point


# --- epochs --------------------------------------------------------------------------


def dev_figures(dev: DataFrame, weights: np.ndarray, names: Sequence[str], at: Sequence[int]) -> DataFrame:
    """(run_id, dev_f1, dev_p, dev_r) of every head on a design table, at probability 0.5.

    `at` is the target of each head. All heads are scored in one pass and counted in one
    aggregation, which is a few numbers a head for each task.
    """
    scored = target_margins(dev, weights)
    cells = [
        F.struct(F.lit(n).alias("run_id"), (F.col("margins")[k] >= 0).alias("hit"), (F.col("targets")[t] > 0).alias("y"))
        for k, (n, t) in enumerate(zip(names, at))
    ]
    counts = (
        scored.select(F.inline(F.array(*cells)))
        .groupBy("run_id")
        .agg(F.count_if(F.col("y") & F.col("hit")).alias("tp"), F.count_if(~F.col("y") & F.col("hit")).alias("fp"), F.count_if(F.col("y") & ~F.col("hit")).alias("fn"))
    )
    return counts.select(
        "run_id",
        f1_from_counts("tp", "fp", "fn").alias("dev_f1"),
        safe_ratio("tp", F.col("tp") + F.col("fp")).alias("dev_p"),
        safe_ratio("tp", F.col("tp") + F.col("fn")).alias("dev_r"),
    )


@dataclass
class _Run:
    state: Lbfgs
    kept: np.ndarray
    history: list[dict]
    ended: bool = False


def _load(spark, folder: str, names: Sequence[str]) -> tuple[int, list[_Run]]:
    """The last epoch that was written whole, and its runs; 0 if there is none."""
    try:
        found = spark.read.schema("run_id string, state binary, kept binary, history string, ended boolean, epoch int").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    whole = found.groupBy("epoch").agg(F.count("*").alias("n")).where(F.col("n") == len(names)).agg(F.max("epoch")).first()[0]
    if whole is None:
        return 0, []
    rows = {r["run_id"]: r for r in found.where(F.col("epoch") == whole).collect()}
    if set(rows) != set(names):
        raise ValueError(f"{folder} holds other runs: {sorted(rows)}")
    runs = [
        _Run(Lbfgs.from_bytes(rows[n]["state"]), np.frombuffer(rows[n]["kept"]).copy(), json.loads(rows[n]["history"]), rows[n]["ended"])
        for n in names
    ]
    return whole, runs


def _save(spark, folder: str, epoch: int, names: Sequence[str], runs: Sequence[_Run]) -> None:
    rows = [(n, r.state.to_bytes(), r.kept.tobytes(), json.dumps(r.history), r.ended) for n, r in zip(names, runs)]
    table = spark.createDataFrame(rows, "run_id string, state binary, kept binary, history string, ended boolean")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


@dataclass(frozen=True)
class Epochs:
    """The kept point of every run, and the history of all: (run_id, epoch, loss, dev_f1, dev_p, dev_r)."""

    points: list[np.ndarray]
    history: DataFrame


def train_epochs(
    table: DataFrame,
    dev: DataFrame,
    objective: Heads | Shared,
    epochs: int = 10,
    steps: int = 5,
    patience: int = 5,
    folder: str | None = None,
    tolerance: float = 1e-7,
) -> Epochs:
    """Fit in epochs of `steps` scans; after each, score dev and keep a run's point if its F1 beat all before.

    A run ends by the early-stop rule of its history (`patience` epochs without a better F1) or
    when its optimiser has settled; the others go on. The kept point of a run that never
    had a true positive is its last. With a `folder` in shared storage, every epoch is written
    there, and a fit that was killed goes on behind the last epoch that was written whole: call it again
    with the same tables. The driver holds a few vectors of the model's size for each run.
    """
    spark, names = table.sparkSession, list(objective.names)
    first, runs = _load(spark, folder, names) if folder else (0, [])
    table, dev = packed(table), packed(dev)
    runs = runs or [_Run(Lbfgs(objective.start(), tolerance=tolerance), objective.start(), []) for _ in names]
    for epoch in range(first + 1, epochs + 1):
        active = [k for k, run in enumerate(runs) if not run.ended]
        if not active:
            break
        now = objective.only(active)
        advance(table, now, [runs[k].state for k in active], steps)
        weights = now.weights([_point(runs[k].state) for k in active])
        at = [h.target for h in now.heads] if isinstance(now, Heads) else [0]
        figures = {r["run_id"]: r.asDict() for r in dev_figures(dev, weights[: len(active)], now.names, at).collect()}
        for k in active:
            run = runs[k]
            line = figures.get(names[k], {"dev_f1": 0.0, "dev_p": 0.0, "dev_r": 0.0})
            before = max([h["dev_f1"] for h in run.history], default=0.0)
            if line["dev_f1"] > before or before == 0.0:
                run.kept = _point(run.state)
            run.history.append({**line, "run_id": names[k], "epoch": epoch, "loss": float(run.state.loss)})
            run.ended = run.state.done
        told = spark.createDataFrame([(h["run_id"], h["epoch"], h["dev_f1"]) for r in runs for h in r.history], "run_id string, epoch bigint, f1 double")
        stopped = {r["run_id"] for r in selection.early_stop(told, patience).where("stop_epoch IS NOT NULL").collect()}
        for name, run in zip(names, runs):
            run.ended = run.ended or name in stopped
        if folder:
            _save(spark, folder, epoch, names, runs)
    lines = [tuple(h[c.split(" ")[0]] for c in HISTORY.split(", ")) for r in runs for h in r.history]
    return Epochs([r.kept for r in runs], spark.createDataFrame(lines, HISTORY))


# --- cross-fitting -------------------------------------------------------------------


def cross_fit(
    table: DataFrame, size: int, folds: int, regs: Sequence[float] = (0.01,), gamma: float = 0.0, steps: int = 40,
    tolerance: float = 1e-7,
) -> tuple[DataFrame, list[Lbfgs]]:
    """(id, run_id, fold, y, score): every row scored by the model that did not see its fold.

    `table` is a design table with folds 0 to `folds` - 1. One model for each fold and
    regularisation (`run-0`, ...) is fitted, all in the same scans: a model's gradient leaves
    out the rows of its fold.
    """
    heads = [Head(f"run-{r}/{f}", 0, gamma, reg, left_out=f) for (r, reg), f in product(enumerate(regs), range(folds))]
    objective = Heads(tuple(heads), size)
    states = fit(table, objective, steps, tolerance)
    scored = margins(table, objective.weights([_point(s) for s in states]), "fold", "targets")
    rows = [
        F.struct(F.lit(f"run-{r}").alias("run_id"), F.get("margins", F.col("fold") + r * folds).alias("logit"))
        for r in range(len(regs))
    ]
    long = scored.select("id", "fold", F.col("targets")[0].cast("int").alias("y"), F.inline(F.array(*rows)))
    return long.select("id", "run_id", "fold", "y", sigmoid("logit").alias("score")), states


def cross_validated_text(
    rows: DataFrame, folds: int = 5, regs: Sequence[float] = (0.001, 0.01, 0.1), gamma: float = 0.0,
    num_features: int = 1 << 18, steps: int = 40, seed: int = 42, weight: str | None = None,
) -> DataFrame:
    """(id, run_id, fold, y, score) of labelled texts (id, text, y), a run for each regularisation.

    Folds are hashes of the id, so copies of an id are in one fold.
    """
    features = fit_features(rows, num_features)
    table = text_design(features, rows, None, weight, hashed_fold(folds, seed))
    return cross_fit(table, num_features, folds, regs, gamma, steps)[0]
