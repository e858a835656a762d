"""Scores, decisions, losses and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator, denominator) -> Column:
    """a / b, and 0 where b is 0 or either is null. ANSI mode would raise on a / 0."""
    ratio = F.try_divide(
        _column(numerator).cast("double"), _column(denominator).cast("double")
    )
    return F.coalesce(ratio, F.lit(0.0))


def percent_of(count, total) -> Column:
    return F.lit(100.0) * safe_ratio(count, total)


def f1_from_counts(tp, fp, fn) -> Column:
    tp, fp, fn = (_column(c) for c in (tp, fp, fn))
    return safe_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)


def sigmoid(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_column(logit)))


def decide(score, threshold) -> Column:
    """1 when the score reaches the threshold (inclusive); null without a score.

    NaN is no score, here and in every figure made from scores.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(has_score(score), (_column(score) >= threshold).cast("int"))


def has_score(score) -> Column:
    """False for null and NaN."""
    score = _column(score)
    return score.isNotNull() & ~F.isnan(score)


def quadrant(y, pred) -> Column:
    y, pred = _column(y), _column(pred)
    return (
        F.when((y == 1) & (pred == 1), "TP")
        .when((y == 0) & (pred == 1), "FP")
        .when((y == 1) & (pred == 0), "FN")
        .when((y == 0) & (pred == 0), "TN")
    )


def bce_with_logits(logit, target) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    x, y = _column(logit), _column(target)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal_loss(logit, target, gamma: float = 2.0) -> Column:
    """Per-row focal loss; reduce it with ``avg`` or ``sum``."""
    y = _column(target)
    p = sigmoid(logit)
    p_true = y * p + (F.lit(1.0) - y) * (F.lit(1.0) - p)
    return F.pow(F.lit(1.0) - p_true, F.lit(float(gamma))) * bce_with_logits(logit, y)
