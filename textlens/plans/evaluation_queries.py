"""Evaluation of the surrogate scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions import seeded_uniform
from textlens.operators import metrics, selection
from textlens.operators.ranking import dense_ordinals, exact_median, prefix_sums
from textlens.plans import fixtures as fx
from textlens.plans.registry import query, u
from textlens.session import settle

_P = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END"
_R = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END"
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"
_PRF = f"round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F1}, 6) AS f1"
_ACC = "(tp + tn)::DOUBLE / (tp + fp + fn + tn)"

# Every distinct score as a cut, with plain counts over the whole table.
_CURVE = """, curve AS (
      SELECT t.score AS threshold, count(*) AS pp, count(*) FILTER (y = 1) AS tp,
             (SELECT count(*) FROM sc WHERE y = 1) AS p
      FROM (SELECT DISTINCT score FROM sc) t JOIN sc ON sc.score >= t.score GROUP BY t.score)
    """


@query("confusion_matrix", "SELECT tn, fp, fn, tp FROM cm")
def _(spark, sf):
    return metrics.confusion_matrix(fx.scored_labels(spark, sf))


@query("binary_metrics", f"SELECT {_PRF}, round({_ACC}, 6) AS accuracy FROM cm")
def _(spark, sf):
    return metrics.binary_metrics(fx.scored_labels(spark, sf))


@query(
    "error_rates",
    "SELECT round(fp::DOUBLE / (fp + tn), 6) AS fpr, round(fn::DOUBLE / (fn + tp), 6) AS fnr FROM cm",
)
def _(spark, sf):
    return metrics.error_rates(fx.scored_labels(spark, sf))


@query(
    "classification_report",
    f""", pc AS (
      SELECT 'positive' AS row, {_P} AS p, {_R} AS r, {_F1} AS f, tp + fn AS s FROM cm
      UNION ALL SELECT 'negative', {_P}, {_R}, {_F1}, tp + fn
      FROM (SELECT tn AS tp, fn AS fp, fp AS fn FROM cm))
    SELECT row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
           s::BIGINT AS support FROM pc
    UNION ALL SELECT 'accuracy', NULL, NULL, round({_ACC}, 6), (tp + fp + fn + tn)::BIGINT FROM cm
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
           sum(s)::BIGINT FROM pc
    UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6),
           round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM pc""",
)
def _(spark, sf):
    return metrics.classification_report(fx.scored_labels(spark, sf))


@query(
    "pr_curve",
    _CURVE
    + """SELECT threshold, round(tp::DOUBLE / pp, 6) AS precision, round(tp::DOUBLE / p, 6) AS recall
    FROM curve UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""",
)
def _(spark, sf):
    return metrics.pr_curve(fx.scored_labels(spark, sf))


@query(
    "prefix_sums",
    """SELECT score, (sum(n) OVER (ORDER BY score DESC))::BIGINT AS cum_n,
      (sum(pos) OVER (ORDER BY score DESC))::BIGINT AS cum_pos
    FROM (SELECT score, count(*) AS n, sum(y) AS pos FROM sc GROUP BY score)""",
)
def _(spark, sf):
    totals = settle(metrics.score_totals(fx.scored_labels(spark, sf)))
    return prefix_sums(totals, "score", ["n", "pos"]).select("score", "cum_n", "cum_pos")


@query(
    "exact_median",
    "SELECT y::INTEGER AS y, round(median(score), 6) AS median_score FROM sc GROUP BY y",
)
def _(spark, sf):
    return exact_median(fx.scored_labels(spark, sf), "score", ["y"])


@query(
    "dense_ordinals",
    """SELECT id, y::INTEGER AS y, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS ordinal
    FROM lab""",
)
def _(spark, sf):
    return dense_ordinals(fx.labels(spark, sf).select("id", "y"), "id", ["y"])


@query(
    "average_precision",
    _CURVE
    + """, steps AS (SELECT tp::DOUBLE / pp AS prec,
        (tp - coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0))::DOUBLE / p AS dr FROM curve)
    SELECT round(sum(prec * dr), 6) AS average_precision FROM steps""",
)
def _(spark, sf):
    return metrics.average_precision(fx.scored_labels(spark, sf))


def _at(thresholds: str) -> str:
    """SQL: counts at each threshold of a one-column relation t(threshold)."""
    return f"""SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp,
        count(*) FILTER (y = 0 AND score >= threshold) AS fp,
        count(*) FILTER (y = 1 AND score < threshold) AS fn
      FROM sc, {thresholds} GROUP BY threshold"""


@query(
    "operating_points",
    f"""SELECT threshold, tp, fp, fn, {_PRF}
    FROM ({_at("(VALUES (0.35::DOUBLE), (0.5::DOUBLE)) AS t(threshold)")})""",
)
def _(spark, sf):
    return metrics.operating_points(fx.scored_labels(spark, sf))


@query(
    "precision_floor",
    _CURVE
    + """SELECT round(coalesce(max(tp::DOUBLE / p), 0), 6) AS max_recall FROM curve
    WHERE tp::DOUBLE / pp >= 0.8""",
)
def _(spark, sf):
    return metrics.precision_floor(fx.scored_labels(spark, sf))


@query("prevalence", "SELECT round(avg(y), 6) AS prevalence FROM sc")
def _(spark, sf):
    return metrics.prevalence(fx.scored_labels(spark, sf))


_QUADRANT = """CASE WHEN y = 1 THEN CASE WHEN pred = 1 THEN 'TP' ELSE 'FN' END
      ELSE CASE WHEN pred = 1 THEN 'FP' ELSE 'TN' END END"""


@query(
    "length_by_quadrant",
    f"""SELECT {_QUADRANT} AS quadrant, round(avg(n_ws), 6) AS mean_len,
      median(n_ws)::DOUBLE AS median_len, max(n_ws)::BIGINT AS max_len FROM sc GROUP BY 1""",
)
def _(spark, sf):
    return metrics.length_by_quadrant(fx.scored_examples(spark, sf))


_GROUPS = f"""SELECT keyword, count(*) AS n_total, count(*) FILTER (y = 1) AS n_pos,
        count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
        count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn
      FROM sc WHERE keyword IS NOT NULL GROUP BY keyword"""


@query(
    "errors_by_group",
    f"""SELECT keyword, n_total, n_pos, tp, fp, fn, tn, round({_R}, 6)::DOUBLE AS recall,
      round({_P}, 6)::DOUBLE AS precision FROM ({_GROUPS})""",
)
def _(spark, sf):
    return metrics.errors_by_group(fx.scored_examples(spark, sf))


_LABELS = """SELECT label, coalesce(sum(l) FILTER (pred = 1), 0)::BIGINT AS tp,
        coalesce(sum(l) FILTER (pred = 0), 0)::BIGINT AS fn
      FROM (SELECT 'low_quality' AS label, l0 AS l, pred FROM sc WHERE y = 1
            UNION ALL SELECT 'toxic', l1, pred FROM sc WHERE y = 1) GROUP BY label"""
_MISS = "CASE WHEN tp + fn = 0 THEN 0 ELSE fn::DOUBLE / (tp + fn) END"


@query(
    "errors_by_label",
    f"""SELECT label, tp, fn, tp + fn AS total_positives, round({_MISS}, 6)::DOUBLE AS miss_rate
    FROM ({_LABELS})""",
)
def _(spark, sf):
    return metrics.errors_by_label(fx.scored_labels(spark, sf), fx.LABEL_NAMES)


@query(
    "worst_groups",
    f"""SELECT * FROM (SELECT 'group' AS kind, keyword AS name, fn::DOUBLE AS value FROM ({_GROUPS})
      ORDER BY fn DESC, keyword LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'label', label, round({_MISS}, 6)::DOUBLE AS m FROM ({_LABELS})
      ORDER BY m DESC, label LIMIT 1)""",
)
def _(spark, sf):
    rows = fx.scored_examples(spark, sf)
    return metrics.worst_groups(
        metrics.errors_by_group(rows),
        metrics.errors_by_label(fx.scored_labels(spark, sf), fx.LABEL_NAMES),
    )


@query(
    "sort_by_metric",
    f"SELECT keyword, fn FROM ({_GROUPS})",
)
def _(spark, sf):
    groups = metrics.errors_by_group(fx.scored_examples(spark, sf))
    return metrics.sort_by_metric(groups, "fn", "keyword").select("keyword", "fn")


@query(
    "score_histogram",
    """, r AS (SELECT y, min(score) AS lo, max(score) AS hi FROM sc GROUP BY y)
    SELECT sc.y::INTEGER AS y,
      least(floor((score - lo) / ((hi - lo) / 40)), 39)::INTEGER AS bin, count(*) AS n
    FROM sc JOIN r ON r.y = sc.y GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.score_histogram(fx.scored_labels(spark, sf))


@query(
    "ensemble_mean",
    f"""SELECT id, round((SELECT avg(s) FROM (SELECT unnest([
      {", ".join(f"round(0.65::DOUBLE * {u(repr(str(m)), 'id')} + 0.35::DOUBLE * y, 6)" for m in (1, 2, 3))}
      ]) AS s)), 6) AS score FROM lab""",
)
def _(spark, sf):
    return metrics.ensemble_mean(fx.scores_long(fx.labels(spark, sf)))


@query(
    "predicted_positives",
    "SELECT sum(pred)::BIGINT AS n_predicted, count(*) AS n_total FROM sc",
)
def _(spark, sf):
    return metrics.predicted_positives(fx.scored_labels(spark, sf))


_GRID = "(SELECT unnest(range(5, 96)) / 100.0::DOUBLE AS threshold) AS t"


@query("threshold_grid", f"SELECT threshold, {_PRF} FROM ({_at(_GRID)})")
def _(spark, sf):
    return metrics.threshold_grid(fx.scored_labels(spark, sf))


@query(
    "threshold_sweep",
    f"""SELECT threshold, f1 FROM (SELECT threshold, {_PRF} FROM ({_at(_GRID)}))
    ORDER BY f1 DESC, threshold LIMIT 1""",
)
def sweep(spark, sf):
    return metrics.threshold_sweep(fx.scored_labels(spark, sf))


@query(
    "relative_improvement",
    f"""SELECT round({_F1}, 6) AS f1, 0.48::DOUBLE AS baseline,
      round(({_F1} - 0.48) / 0.48, 6) AS improvement FROM cm""",
)
def _(spark, sf):
    return metrics.relative_improvement(metrics.binary_metrics(fx.scored_labels(spark, sf)), 0.48)


@query(
    "evaluation_summary",
    _CURVE
    + f""", steps AS (SELECT tp::DOUBLE / pp AS prec,
        (tp - coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0))::DOUBLE / p AS dr FROM curve)
    SELECT metric, round(value, 6) AS value FROM (
      SELECT 'n' AS metric, (tp + fp + fn + tn)::DOUBLE AS value FROM cm
      UNION ALL SELECT 'n_pos', (tp + fn)::DOUBLE FROM cm
      UNION ALL SELECT 'pct_pos', 100.0 * (tp + fn) / (tp + fp + fn + tn) FROM cm
      UNION ALL SELECT 'tp', tp::DOUBLE FROM cm UNION ALL SELECT 'fp', fp::DOUBLE FROM cm
      UNION ALL SELECT 'fn', fn::DOUBLE FROM cm UNION ALL SELECT 'tn', tn::DOUBLE FROM cm
      UNION ALL SELECT 'precision', {_P} FROM cm UNION ALL SELECT 'recall', {_R} FROM cm
      UNION ALL SELECT 'f1', {_F1} FROM cm UNION ALL SELECT 'accuracy', {_ACC} FROM cm
      UNION ALL SELECT 'fpr', fp::DOUBLE / (fp + tn) FROM cm
      UNION ALL SELECT 'fnr', fn::DOUBLE / (fn + tp) FROM cm
      UNION ALL SELECT 'mean_len_' || lower({_QUADRANT}), avg(n_ws) FROM sc GROUP BY 1
      UNION ALL SELECT 'average_precision', sum(prec * dr) FROM steps)""",
)
def _(spark, sf):
    return metrics.evaluation_summary(fx.scored_examples(spark, sf))


@query(
    "hardest_false_positives",
    """SELECT id, keyword, score, text FROM sc WHERE y = 0 AND pred = 1
    ORDER BY score DESC, id LIMIT 10""",
)
def _(spark, sf):
    return metrics.hardest_false_positives(fx.scored_labels(spark, sf), texts=fx.corpus(spark, sf))


@query(
    "hardest_false_negatives",
    """SELECT id, keyword, score, text FROM sc WHERE y = 1 AND pred = 0
    ORDER BY score, id LIMIT 10""",
)
def _(spark, sf):
    return metrics.hardest_false_negatives(fx.scored_labels(spark, sf), texts=fx.corpus(spark, sf))


def _label_score(ix: int) -> str:
    return (
        f"CASE WHEN round(0.65::DOUBLE * {u(repr('label'), repr(str(ix)), 'id')}"
        f" + 0.35::DOUBLE * l{ix}, 6) >= 0.5 THEN 1 ELSE 0 END"
    )


@query(
    "multilabel_metrics",
    f""", cells AS (SELECT '0' AS label, l0 AS y, {_label_score(0)} AS pred FROM lab
      UNION ALL SELECT '1', l1, {_label_score(1)} FROM lab),
    pl AS (SELECT label, count(*) FILTER (y = 1 AND pred = 1) AS tp,
        count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn
      FROM cells GROUP BY label)
    SELECT label, {_PRF} FROM pl
    UNION ALL SELECT 'micro', {_PRF} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM pl)
    UNION ALL SELECT 'macro', round(avg({_P}), 6), round(avg({_R}), 6), round(avg({_F1}), 6) FROM pl""",
)
def _(spark, sf):
    def pred(ix):
        u_label = seeded_uniform("label", ix, F.col("id"))
        score = F.round(F.lit(0.65) * u_label + F.lit(0.35) * F.col("label_vec")[ix], 6)
        return (score >= 0.5).cast("double")

    rows = fx.labels(spark, sf).withColumn("pred_vec", F.array(pred(0), pred(1)))
    return metrics.multilabel_metrics(rows)


_HISTORY = f""", s AS (
      SELECT run_id, epoch, y,
        round(0.65::DOUBLE * {u("run_id", "epoch", "id")} + 0.35::DOUBLE * y, 6) AS score
      FROM lab, (VALUES ('a'), ('b'), ('c')) AS r(run_id), (SELECT unnest(range(1, 11)) AS epoch)),
    c AS (SELECT run_id, epoch, count(*) FILTER (y = 1 AND score >= 0.5) AS tp,
        count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn
      FROM s GROUP BY run_id, epoch),
    h AS (SELECT run_id, epoch::INTEGER AS epoch, {_F1} AS f1 FROM c),
    i AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM h b WHERE b.run_id = a.run_id
                                  AND b.epoch < a.epoch AND b.f1 >= a.f1) AND f1 > 0 AS improved
      FROM h a)
    """
_PATIENCE = """, k AS (SELECT *, epoch - coalesce((SELECT max(epoch) FROM i b WHERE b.run_id = i.run_id
        AND b.epoch <= i.epoch AND b.improved), 0) AS streak FROM i),
    stops AS (SELECT run_id, min(epoch) FILTER (streak >= 3) AS stop_epoch FROM k GROUP BY run_id),
    best AS (SELECT k.run_id, any_value(stop_epoch) AS stop_epoch, max(epoch) AS last_epoch,
        max(epoch) FILTER (improved) AS best_epoch,
        coalesce(max(f1) FILTER (improved), 0) AS best_f1
      FROM k JOIN stops ON stops.run_id = k.run_id
      WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY k.run_id)
    """


def _history(spark, sf):
    return selection.history_from_scores(fx.run_history_scores(spark, sf))


@query(
    "best_checkpoint",
    _HISTORY
    + """SELECT run_id, epoch, round(f1, 6) AS f1, improved,
      epoch = (SELECT max(epoch) FROM i b WHERE b.run_id = i.run_id AND improved) AS is_best FROM i""",
)
def _(spark, sf):
    return selection.best_checkpoint(_history(spark, sf))


@query(
    "early_stop",
    _HISTORY
    + _PATIENCE
    + """SELECT run_id, stop_epoch, last_epoch, best_epoch, round(best_f1, 6) AS best_f1 FROM best""",
)
def _(spark, sf):
    return selection.early_stop(_history(spark, sf), patience=3)


@query(
    "search_runs",
    _HISTORY
    + _PATIENCE
    + """SELECT run_id, best_epoch, round(best_f1, 6) AS best_f1 FROM best
    ORDER BY best.best_f1 DESC, run_id LIMIT 1""",
)
def _(spark, sf):
    return selection.search_runs(_history(spark, sf), patience=3)
