"""Published figures of an evaluation, rebuilt from its published counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlens.operators import metrics, selection
from textlens.schemas import LABEL_NAMES

# keyword, TP, FP, FN, TN, recall, precision (fixed values).
KEYWORDS = [
    ("poor-families", 18, 12, 20, 140, 0.474, 0.6),
    ("homeless", 18, 7, 11, 176, 0.621, 0.72),
    ("vulnerable", 9, 5, 11, 184, 0.45, 0.643),
    ("hopeless", 15, 11, 11, 180, 0.577, 0.577),
    ("women", 4, 4, 10, 215, 0.286, 0.5),
    ("disabled", 7, 3, 7, 177, 0.5, 0.7),
    ("immigrant", 2, 1, 5, 210, 0.286, 0.667),
    ("refugee", 8, 4, 5, 171, 0.615, 0.667),
    ("migrant", 2, 1, 3, 201, 0.4, 0.667),
    ("in-need", 30, 13, 3, 180, 0.909, 0.698),
]

# label, TP, FN, miss rate, in vector order (fixed values).
LABELS = [
    ("Unbalanced Power Relations", 93, 49, 0.345),
    ("Shallow Solution", 26, 10, 0.278),
    ("Presupposition", 31, 31, 0.5),
    ("Authority Voice", 20, 18, 0.474),
    ("Metaphor", 33, 19, 0.365),
    ("Compassion", 65, 41, 0.387),
    ("The Poorer, the Merrier", 5, 6, 0.545),
]

# Development F1 per epoch (fixed values).
HISTORY = [
    0.5616161616161616,
    0.5235772357723577,
    0.5720430107526882,
    0.5380116959064327,
    0.5735294117647058,
    0.5876993166287016,
    0.6058981233243967,
    0.6027397260273972,
    0.5835411471321695,
    0.585,
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for keyword, tp, fp, fn, tn, *_ in KEYWORDS:
        rows += [(keyword, 1, 1)] * tp + [(keyword, 0, 1)] * fp
        rows += [(keyword, 1, 0)] * fn + [(keyword, 0, 0)] * tn
    return spark.createDataFrame(rows, "keyword string, y int, pred int").repartition(4)


def test_global_metrics(scored):
    assert scored.count() == 2094
    assert metrics.confusion_matrix(scored).first().asDict() == {
        "tn": 1834, "fp": 61, "fn": 86, "tp": 113,
    }
    m = metrics.binary_metrics(scored).first()
    assert [round(x, 4) for x in (m.precision, m.recall, m.f1, m.accuracy)] == [
        0.6494, 0.5678, 0.6059, 0.9298,
    ]
    r = metrics.error_rates(scored).first()
    assert (round(r.fpr, 4), round(r.fnr, 4)) == (0.0322, 0.4322)
    p = metrics.predicted_positives(scored).first()
    assert (p.n_predicted, p.n_total) == (174, 2094)
    gain = metrics.relative_improvement(metrics.binary_metrics(scored), 0.48).first()
    assert round(gain.improvement, 2) == 0.26


def test_classification_report(scored):
    rows = {r["row"]: r for r in metrics.classification_report(scored).collect()}

    def figures(name):
        r = rows[name]
        return [None if x is None else round(x, 4) for x in (r.precision, r.recall, r.f1)] + [r.support]

    assert figures("negative") == [0.9552, 0.9678, 0.9615, 1895]
    assert figures("positive") == [0.6494, 0.5678, 0.6059, 199]
    assert figures("accuracy") == [None, None, 0.9298, 2094]
    assert figures("macro avg") == [0.8023, 0.7678, 0.7837, 2094]
    assert figures("weighted avg") == [0.9261, 0.9298, 0.9277, 2094]


def test_errors_by_keyword(scored):
    table = metrics.sort_by_metric(metrics.errors_by_group(scored), "fn", "keyword").collect()
    got = {
        r.keyword: (r.tp, r.fp, r.fn, r.tn, round(r.recall, 3), round(r.precision, 3)) for r in table
    }
    assert got == {k: tuple(rest) for k, *rest in KEYWORDS}
    assert table[0].keyword == "poor-families"
    assert [r.keyword for r in table[1:4]] == ["homeless", "hopeless", "vulnerable"]


def test_errors_by_label(spark):
    width = len(LABEL_NAMES)
    rows = []
    for ix, (_, tp, fn, _) in enumerate(LABELS):
        vector = [1.0 if i == ix else 0.0 for i in range(width)]
        rows += [(1, 1, vector)] * tp + [(1, 0, vector)] * fn
    # A wrongly accepted negative takes no part.
    rows.append((0, 1, [0.0] * width))
    scored = spark.createDataFrame(rows, "y int, pred int, label_vec array<double>")
    table = metrics.errors_by_label(scored, LABEL_NAMES)
    got = {r.label: (r.tp, r.fn, round(r.miss_rate, 3)) for r in table.collect()}
    assert got == {name: (tp, fn, rate) for name, tp, fn, rate in LABELS}
    worst = metrics.sort_by_metric(table, "miss_rate", "label").first()
    assert worst.label == "The Poorer, the Merrier"


def _history(spark, values):
    rows = [("run", i, f) for i, f in enumerate(values, start=1)]
    return spark.createDataFrame(rows, "run_id string, epoch int, f1 double").repartition(3)


def test_best_epoch(spark):
    flagged = selection.best_checkpoint(_history(spark, HISTORY)).orderBy("epoch").collect()
    assert [r.epoch for r in flagged if r.improved] == [1, 3, 5, 6, 7]
    assert [r.epoch for r in flagged if r.is_best] == [7]


def test_no_early_stop(spark):
    stop = selection.early_stop(_history(spark, HISTORY), patience=5).first()
    assert (stop.stop_epoch, stop.last_epoch, stop.best_epoch) == (None, 10, 7)
    streaks = selection.with_patience(_history(spark, HISTORY)).orderBy("epoch").collect()
    assert [r.streak for r in streaks][-4:] == [0, 1, 2, 3]


def test_early_stop_discards_later_epochs(spark):
    stop = selection.early_stop(_history(spark, [0.3, 0.2, 0.3, 0.9]), patience=2).first()
    assert (stop.stop_epoch, stop.last_epoch, stop.best_epoch, stop.best_f1) == (3, 3, 1, 0.3)
    never = selection.early_stop(_history(spark, [0.0, 0.0]), patience=5).first()
    assert (never.stop_epoch, never.best_epoch, never.best_f1) == (None, None, 0.0)


def test_best_run(spark):
    runs = _history(spark, [0.1, 0.5]).unionByName(
        _history(spark, [0.5, 0.2]).withColumn("run_id", F.lit("a-run"))
    )
    best = selection.search_runs(runs).first()
    assert (best.run_id, best.best_epoch, best.best_f1) == ("a-run", 1, 0.5)
