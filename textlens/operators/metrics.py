"""Evaluation of scored tables: (id, keyword, y, pred, score, n_ws_tokens, label_vec, text)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.scoring import (
    f1_from_counts,
    has_score,
    percent_of,
    quadrant,
    safe_ratio,
)
from textlens.operators.ranking import first_rows, prefix_sums
from textlens.session import settle


def _counts(y: str = "y", pred: str = "pred") -> list[Column]:
    t, p = F.col(y), F.col(pred)
    return [
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
    ]


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.agg(*_counts()).select("tn", "fp", "fn", "tp")


def _precision() -> Column:
    return safe_ratio("tp", F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return safe_ratio("tp", F.col("tp") + F.col("fn"))


def _f1() -> Column:
    return f1_from_counts("tp", "fp", "fn")


def _all_rows() -> Column:
    return F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")


def binary_metrics(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class, and accuracy."""
    return confusion_matrix(scored).select(
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
        safe_ratio(F.col("tp") + F.col("tn"), _all_rows()).alias("accuracy"),
    )


def error_rates(scored: DataFrame) -> DataFrame:
    return confusion_matrix(scored).select(
        safe_ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"),
        safe_ratio("fn", F.col("fn") + F.col("tp")).alias("fnr"),
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Per class, accuracy, macro and weighted averages as five rows."""
    c = confusion_matrix(scored)
    per_class = c.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("negative").alias("row"),
                    F.col("tn").alias("tp"),
                    F.col("fn").alias("fp"),
                    F.col("fp").alias("fn"),
                ),
                F.struct(
                    F.lit("positive").alias("row"),
                    F.col("tp").alias("tp"),
                    F.col("fp").alias("fp"),
                    F.col("fn").alias("fn"),
                ),
            )
        )
    ).select(
        "row",
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )
    names = ("precision", "recall", "f1")
    macro = per_class.agg(
        *[F.avg(m).alias(m) for m in names], F.sum("support").alias("support")
    ).select(F.lit("macro avg").alias("row"), *names, "support")
    weighted = per_class.agg(
        *[safe_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names],
        F.sum("support").alias("support"),
    ).select(F.lit("weighted avg").alias("row"), *names, "support")
    share = safe_ratio(F.col("tp") + F.col("tn"), _all_rows())
    accuracy = c.select(
        F.lit("accuracy").alias("row"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        share.alias("f1"),
        _all_rows().alias("support"),
    )
    return per_class.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def score_totals(scored: DataFrame) -> DataFrame:
    """Rows and positives per distinct score: ties share one point of every curve."""
    return (
        scored.filter(has_score("score"))
        .groupBy("score")
        .agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    )


def _ranked_scores(scored: DataFrame) -> DataFrame:
    return prefix_sums(settle(score_totals(scored)), "score", ["n", "pos"])


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, plus the end point (1, 0).

    Without any positive, recall is 1 throughout.
    """
    ranked = _ranked_scores(scored)
    recall = F.when(F.col("total_pos") > 0, safe_ratio("cum_pos", "total_pos")).otherwise(1.0)
    points = ranked.select(
        F.col("score").alias("threshold"),
        safe_ratio("cum_pos", "cum_n").alias("precision"),
        recall.alias("recall"),
    )
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of precision times recall step over the distinct scores."""
    step = safe_ratio("pos", "total_pos") * safe_ratio("cum_pos", "cum_n")
    return _ranked_scores(scored).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision")
    )


def operating_points(scored: DataFrame, thresholds: Sequence[float] = (0.35, 0.5)) -> DataFrame:
    """Counts and metrics at chosen thresholds: one aggregation, then one row each."""
    points = [float(t) for t in thresholds]
    y, score = F.col("y"), F.col("score")
    sums = []
    for i, t in enumerate(points):
        sums += [
            F.count_if((y == 1) & (score >= t)).alias(f"tp{i}"),
            F.count_if((y == 0) & (score >= t)).alias(f"fp{i}"),
            F.count_if((y == 1) & (score < t)).alias(f"fn{i}"),
        ]
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")],
        )
        for i, t in enumerate(points)
    ]
    counts = scored.agg(*sums).select(F.inline(F.array(*rows)))
    return counts.select(
        "threshold",
        "tp",
        "fp",
        "fn",
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
    )


def precision_floor(scored: DataFrame, floor: float = 0.80) -> DataFrame:
    """Highest recall that keeps precision at the floor or above."""
    points = pr_curve(scored).filter(F.col("threshold").isNotNull())
    return points.filter(F.col("precision") >= floor).agg(
        F.coalesce(F.max("recall"), F.lit(0.0)).alias("max_recall")
    )


def prevalence(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.col("y")).alias("prevalence"))


def length_by_quadrant(scored: DataFrame, length: str = "n_ws_tokens") -> DataFrame:
    """Mean, median and maximum length per quadrant; null lengths are skipped."""
    tagged = scored.select(quadrant("y", "pred").alias("quadrant"), F.col(length))
    return tagged.groupBy("quadrant").agg(
        F.avg(length).alias("mean_len"),
        F.median(length).alias("median_len"),
        F.max(length).cast("bigint").alias("max_len"),
    )


def errors_by_group(scored: DataFrame, column: str = "keyword") -> DataFrame:
    """Counts, recall and precision per group; rows without a group or a decision are dropped."""
    groups = (
        scored.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            F.count("pred").alias("n_total"),
            F.count_if((F.col("y") == 1) & F.col("pred").isNotNull()).alias("n_pos"),
            *_counts(),
        )
    )
    return groups.select(
        column,
        "n_total",
        "n_pos",
        "tp",
        "fp",
        "fn",
        "tn",
        safe_ratio("tp", "n_pos").alias("recall"),
        _precision().alias("precision"),
    )


def errors_by_label(
    scored: DataFrame, names: Sequence[str], vector: str = "label_vec"
) -> DataFrame:
    """Per label among the true positives of the binary task: found, missed, miss rate."""
    positives = scored.filter(F.col("y") == 1)
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_ix") + 1)
    cells = positives.select("pred", F.posexplode(vector).alias("_ix", "_value"))

    def total(pred: int) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("pred") == pred, F.col("_value"))), F.lit(0.0)
        ).cast("bigint")

    return (
        cells.groupBy("_ix")
        .agg(total(1).alias("tp"), total(0).alias("fn"))
        .select(
            named.alias("label"),
            "tp",
            "fn",
            (F.col("tp") + F.col("fn")).alias("total_positives"),
            safe_ratio("fn", F.col("tp") + F.col("fn")).alias("miss_rate"),
        )
    )


def sort_by_metric(table: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Largest first, with a key that makes the order total."""
    return table.orderBy(F.col(metric).desc(), *[F.col(k).asc() for k in keys])


def worst_groups(by_group: DataFrame, by_label: DataFrame, column: str = "keyword") -> DataFrame:
    """The group with most missed positives and the label with the highest miss rate."""
    group = first_rows(by_group, 1, [F.col("fn").desc(), F.col(column).asc()])
    label = first_rows(by_label, 1, [F.col("miss_rate").desc(), F.col("label").asc()])
    return group.select(
        F.lit("group").alias("kind"),
        F.col(column).alias("name"),
        F.col("fn").cast("double").alias("value"),
    ).unionByName(
        label.select(
            F.lit("label").alias("kind"), F.col("label").alias("name"), F.col("miss_rate").alias("value")
        )
    )


def score_histogram(scored: DataFrame, bins: int = 40, per_class_range: bool = True) -> DataFrame:
    """Score distribution per class over the class's own range (or the common one)."""
    totals = scored.filter(F.col("score").isNotNull()).select("y", "score")
    # Two rows, one per class.
    ranges = totals.groupBy("y").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    if not per_class_range:
        both = Window.partitionBy()
        ranges = ranges.select(
            "y", F.min("low").over(both).alias("low"), F.max("high").over(both).alias("high")
        )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    at = F.floor(safe_ratio(F.col("score") - F.col("low"), width)).cast("int")
    return (
        totals.join(F.broadcast(ranges), "y")
        .groupBy("y", F.least(at, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def ensemble_mean(scores: DataFrame) -> DataFrame:
    """Mean score over the models, per id."""
    return scores.groupBy("id").agg(F.avg("score").alias("score"))


def predicted_positives(scored: DataFrame) -> DataFrame:
    """Accepted rows, and rows with a decision."""
    return scored.agg(
        F.coalesce(F.sum(F.col("pred").cast("bigint")), F.lit(0)).alias("n_predicted"),
        F.count("pred").alias("n_total"),
    )


def threshold_grid(
    scored: DataFrame, lo: float = 0.05, hi: float = 0.95, step: float = 0.01
) -> DataFrame:
    """Precision, recall and F1 at every grid threshold, in one pass over the scores.

    Each score is mapped to the last grid point it reaches; the counts at a threshold
    are then sums over the grid points from there up. Grid points are lo + i * step in
    decimals, up to hi, so a score equal to a grid point counts as reached.
    """
    start, end, width = (Decimal(str(x)) for x in (lo, hi, step))
    points = [float(start + i * width) for i in range(int((end - start) // width) + 1)]
    last = len(points) - 1
    at = F.array(*[F.lit(p) for p in points])
    guess = F.least(
        F.greatest(F.floor((F.col("score") - F.lit(points[0])) / F.lit(float(width))), F.lit(-1).cast("bigint")),
        F.lit(last).cast("bigint"),
    ).cast("int")
    reached = (
        F.when((guess < last) & (F.col("score") >= F.get(at, guess + 1)), guess + 1)
        .when((guess >= 0) & (F.col("score") < F.get(at, guess)), guess - 1)
        .otherwise(guess)
    )
    totals = (
        scored.filter(has_score("score"))
        .groupBy(reached.cast("bigint").alias("i"))
        .agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    )
    grid = scored.sparkSession.range(-1, last + 1).withColumnRenamed("id", "i")
    filled = grid.join(totals, "i", "left").fillna(0, ["n", "pos"])
    # As many rows as grid points, so one task is enough.
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_points = Window.partitionBy()
    counts = filled.select(
        "i",
        F.sum("pos").over(above).alias("tp"),
        (F.sum("n").over(above) - F.sum("pos").over(above)).alias("fp"),
        (F.sum("pos").over(all_points) - F.sum("pos").over(above)).alias("fn"),
    )
    return counts.filter(F.col("i") >= 0).select(
        F.get(at, F.col("i").cast("int")).alias("threshold"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
    )


def threshold_sweep(
    scored: DataFrame,
    lo: float = 0.05,
    hi: float = 0.95,
    step: float = 0.01,
    fallback: float = 0.5,
) -> DataFrame:
    """The smallest threshold with the best F1; the fallback when F1 is never positive."""
    grid = threshold_grid(scored, lo, hi, step)
    best = first_rows(grid, 1, [F.col("f1").desc(), F.col("threshold").asc()])
    return best.select(
        F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(float(fallback))).alias("threshold"),
        "f1",
    )


def relative_improvement(metrics: DataFrame, baseline: float) -> DataFrame:
    """(F1 - baseline) / baseline."""
    gain = safe_ratio(F.col("f1") - F.lit(float(baseline)), F.lit(float(baseline)))
    return metrics.select("f1", F.lit(float(baseline)).alias("baseline"), gain.alias("improvement"))


def _hardest(scored: DataFrame, y: int, pred: int, k: int, by_score, texts: DataFrame | None) -> DataFrame:
    wrong = scored.filter((F.col("y") == y) & (F.col("pred") == pred))
    order = [by_score, F.col("id").asc()]
    if texts is None:
        return first_rows(wrong.select("id", "keyword", "score", "text"), k, order)
    # k rows, so that neither texts nor scores are shuffled for them
    top = F.broadcast(first_rows(wrong.select("id", "score"), k, order))
    found = top.join(texts.select("id", "keyword", "text"), "id")
    missing = top.join(found.select("id"), "id", "left_anti")
    nothing = F.lit(None).cast("string")
    return found.select("id", "keyword", "score", "text").unionByName(
        missing.select("id", nothing.alias("keyword"), "score", nothing.alias("text"))
    )


def hardest_false_positives(scored: DataFrame, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """Wrongly accepted rows with the highest scores.

    With ``texts`` (id, keyword, text) ``scored`` needs neither: ids and scores are ranked, and
    only the k rows meet their texts.
    """
    return _hardest(scored, 0, 1, k, F.col("score").desc(), texts)


def hardest_false_negatives(scored: DataFrame, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """Missed positives with the lowest scores; ``texts`` as for false positives."""
    return _hardest(scored, 1, 0, k, F.col("score").asc(), texts)


def multilabel_metrics(
    rows: DataFrame, truth: str = "label_vec", pred: str = "pred_vec"
) -> DataFrame:
    """Precision, recall and F1 per label, and their micro and macro averages."""
    cells = rows.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(pred).alias("p"))))
    pairs = cells.select(
        F.col("pos").alias("ix"),
        (F.col("col")["t"] > 0).cast("int").alias("y"),
        (F.col("col")["p"] > 0).cast("int").alias("pred"),
    )
    per_label = pairs.groupBy("ix").agg(*_counts())
    names = ("precision", "recall", "f1")
    rated = per_label.select(
        F.col("ix").cast("string").alias("label"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
    )
    micro = per_label.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(
        F.lit("micro").alias("label"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
    )
    macro = rated.agg(*[F.avg(m).alias(m) for m in names]).select(
        F.lit("macro").alias("label"), *names
    )
    return rated.unionByName(micro).unionByName(macro)


def _as_metrics(row: DataFrame, names: Sequence[str], prefix: str = "") -> DataFrame:
    """A one-row table as (metric, value) rows."""
    pairs = [
        F.struct(F.lit(prefix + n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in names
    ]
    return row.select(F.inline(F.array(*pairs)))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Global figures as a long (metric, value) table.

    Counts and everything derived from them come from one aggregation. Scores and lengths
    are settled first, so that the texts behind them are read once.
    """
    scored = settle(scored.select("y", "pred", "score", "n_ws_tokens"))
    counts = scored.agg(
        *_counts(),
        *[
            F.avg(F.when(quadrant("y", "pred") == q, F.col("n_ws_tokens"))).alias(
                f"mean_len_{q.lower()}"
            )
            for q in ("TP", "FP", "FN", "TN")
        ],
    )
    n = _all_rows()
    positives = F.col("tp") + F.col("fn")
    derived = counts.select(
        n.alias("n"),
        positives.alias("n_pos"),
        percent_of(positives, n).alias("pct_pos"),
        "tp",
        "fp",
        "fn",
        "tn",
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
        safe_ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        safe_ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"),
        safe_ratio("fn", positives).alias("fnr"),
        "mean_len_tp",
        "mean_len_fp",
        "mean_len_fn",
        "mean_len_tn",
    )
    parts = [
        _as_metrics(derived, derived.columns),
        _as_metrics(average_precision(scored), ["average_precision"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
