"""Training on the labelled documents and scoring the rest."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from textlens.operators import modelling, rebalance, training
from textlens.operators.gradient_fit import Head, Heads, design, gradient_sums, hashed_fold
from textlens.operators.metrics import multilabel_metrics, threshold_sweep
from textlens.plans import fixtures as fx
from textlens.plans.registry import query, u
from textlens.session import settle

_NB = r""", f AS (SELECT y, unnest(toks) AS term FROM tok),
    c AS (SELECT term, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg
      FROM f GROUP BY term),
    t AS (SELECT sum(n_pos) AS p, sum(n_neg) AS n, count(*) AS v FROM c),
    w AS (SELECT term, ln((n_pos + 1) / (p + v)::DOUBLE) - ln((n_neg + 1) / (n + v)::DOUBLE) AS odds
      FROM c, t),
    alltok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term
      FROM documents),
    s AS (SELECT alltok.id, sum(odds) AS odds FROM alltok JOIN w ON w.term = alltok.term GROUP BY 1),
    nb AS (SELECT *, 1 / (1 + exp(-log_odds)) AS score FROM (
      SELECT d.doc_id AS id,
        coalesce(s.odds, 0) + (SELECT ln((np + 1) / (nn + 1)::DOUBLE) FROM size) AS log_odds
      FROM documents d LEFT JOIN s ON s.id = d.doc_id))
    """


@query(
    "naive_bayes_scores",
    _NB
    + "SELECT id, 'nb' AS model_id, round(score, 6) AS score, round(log_odds, 3) AS log_odds FROM nb",
)
def _(spark, sf):
    model = _model(spark, sf)
    documents = fx.with_tokens(fx.all_documents(spark, sf).select("id", "text"))
    scores = modelling.naive_bayes_scores(model, documents)
    return scores.withColumn("log_odds", F.round("log_odds", 3))


@query(
    "naive_bayes_rare_terms",
    _NB
    + "SELECT id, 'nb' AS model_id, round(score, 6) AS score, round(log_odds, 3) AS log_odds FROM nb",
)
def _(spark, sf):
    # Few hot terms: most terms take the way of a large vocabulary.
    model = modelling.train_naive_bayes(fx.tokens(spark, sf), examples=fx.labels(spark, sf), hot_terms=100)
    documents = fx.with_tokens(fx.all_documents(spark, sf).select("id", "text"))
    return modelling.naive_bayes_scores(model, documents).withColumn("log_odds", F.round("log_odds", 3))


def _model(spark, sf):
    return modelling.train_naive_bayes(fx.tokens(spark, sf), examples=fx.labels(spark, sf))


@query(
    "predict_split",
    _NB
    + """, rest AS (SELECT * FROM nb WHERE id NOT IN (SELECT id FROM lab))
    SELECT id, round(score, 6) AS score,
      CASE WHEN score >= (SELECT threshold FROM (
        SELECT g.threshold, count(*) FILTER (y = 1 AND score >= g.threshold) AS tp,
          count(*) FILTER (y = 0 AND score >= g.threshold) AS fp,
          count(*) FILTER (y = 1 AND score < g.threshold) AS fn
        FROM nb JOIN lab ON lab.id = nb.id,
          (SELECT unnest(range(5, 96)) / 100.0::DOUBLE AS threshold) g GROUP BY g.threshold)
        ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, threshold LIMIT 1) THEN 1 ELSE 0 END AS pred
    FROM rest""",
)
def _(spark, sf):
    # Every document is scored once; the labelled ones give the threshold.
    documents = fx.with_tokens(fx.all_documents(spark, sf).select("id", "text"))
    scores = settle(modelling.naive_bayes_scores(_model(spark, sf), documents))
    labels = fx.labels(spark, sf).select("id", "y")
    threshold = threshold_sweep(scores.select("id", "score").join(labels, "id"))
    rest = scores.join(labels, "id", "left_anti")
    return modelling.predict_split(rest, threshold)


@query("train_text_classifier")
def _(spark, sf):
    rows = fx.examples(spark, sf)
    model = modelling.train_text_classifier(rebalance.class_weights(rows))
    return modelling.score_text(model, rows)


@query("train_label_heads")
def _(spark, sf):
    rows = fx.examples(spark, sf)
    scores = training.train_label_heads(rows, fx.WIDTH).label_scores(rows)
    return scores.select(
        "id", *[F.col("label_scores")[i].alias(n) for i, n in enumerate(fx.LABEL_NAMES)]
    )


@query("label_heads_metrics")
def _(spark, sf):
    rows = fx.examples(spark, sf)
    scores = training.train_label_heads(rows, fx.WIDTH).label_scores(rows)
    decided = F.transform("label_scores", lambda s: (s >= 0.5).cast("double"))
    return multilabel_metrics(rows.select("id", "label_vec").join(scores.select("id", decided.alias("pred_vec")), "id"))


@query("train_focal")
def _(spark, sf):
    rows = rebalance.class_weights(fx.examples(spark, sf))
    return training.train_focal(rows, fx.WIDTH, weight="weight")[0].scores(rows, "focal")


@query("train_focal_shared")
def _(spark, sf):
    rows = rebalance.class_weights(fx.examples(spark, sf))
    model, _ = training.train_focal(rows, fx.WIDTH, rank=4, reg=0.001, num_features=1 << 16, weight="weight")
    return model.scores(rows, "focal-shared")


@query("train_svm")
def _(spark, sf):
    rows = fx.examples(spark, sf)
    model, _ = training.train_svm(rows, weight=None)
    return model.logits(rows).select("id", F.col("margins")[0].alias("margin"))


@query("cross_validated_scores")
def _(spark, sf):
    return training.cross_validated_text(fx.examples(spark, sf), folds=5, num_features=1 << 16, steps=25)


@query(
    "cross_validation_folds",
    f"""SELECT id, floor({u("'fold'", "42", "id")} * 5)::INTEGER AS fold FROM lab""",
)
def _(spark, sf):
    return fx.labels(spark, sf).select("id", hashed_fold(5).alias("fold"))


@query("training_history")
def _(spark, sf):
    """Three regularisations in epochs; the dev part is fold 0 of five."""
    rows = fx.examples(spark, sf)
    features = training.fit_features(rows)
    runs = tuple(Head(f"run-{i}", 0, 2.0, reg) for i, reg in enumerate((0.0001, 0.001, 0.01)))
    table, dev = (
        training.text_blocks(features, rows.where(part))
        for part in (hashed_fold(5) > 0, hashed_fold(5) == 0)
    )
    return training.train_epochs(table, dev, Heads(runs, 1 << 18), epochs=10, steps=3, patience=3).history


_POINT = "list_transform(range(64), lambda j: 0.25 * cos(j * 1.0::DOUBLE + {k}))"


@query(
    "objective_gradient",
    f""", e AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
      floor({u("'fold'", "42", "vec_id")} * 4) AS fold FROM embeddings),
    h AS (
      SELECT 'focal' AS head, 2 AS gamma, x, y, list_inner_product(x, {_POINT.format(k=0)}) - 0.5 AS z FROM e
      UNION ALL SELECT 'fold', 0, x, y, list_inner_product(x, {_POINT.format(k=1)}) + 0.25 FROM e WHERE fold <> 1),
    p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM h),
    m AS (SELECT *, y * (1 - p) + (1 - y) * p AS miss, -ln(y * p + (1 - y) * (1 - p)) AS ce FROM p),
    s AS (SELECT *, miss ** gamma * ce AS loss,
      miss ** gamma * (p - y) - gamma * miss ** (gamma - 1) * ce * (2 * y - 1) * p * (1 - p) AS slope FROM m)
    SELECT head, 'loss' AS part, 0::BIGINT AS coordinate, round(sum(loss) / count(*), 6) AS value FROM s GROUP BY head
    UNION ALL SELECT head, 'gradient', 64, round(sum(slope) / count(*), 6) FROM s GROUP BY head
    UNION ALL SELECT head, 'gradient', j - 1, round(sum(slope * v) / count(*), 6)
      FROM (SELECT head, slope, unnest(x) AS v, unnest(range(1, 65)) AS j FROM s) GROUP BY head, j""",
)
def _(spark, sf):
    """Loss and gradient of two heads at a fixed point: one scan of the distributed fit."""
    vectors = fx.table(spark, sf, "embeddings").withColumn("id", F.col("vec_id"))
    table = design(
        vectors.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>"))),
        "v",
        F.array((F.col("label") >= 5).cast("double")),
        fold=hashed_fold(4),
    )
    j = np.arange(64)
    points = np.stack([np.append(0.25 * np.cos(j), -0.5), np.append(0.25 * np.cos(j + 1), 0.25)])
    heads = Heads((Head("focal", 0, 2.0), Head("fold", 0, 0.0, left_out=1)), 64)
    loss, gradient = gradient_sums(table, heads, points)
    rows = [
        (head.name, part, at, float(value / loss[k, 1]))
        for k, head in enumerate(heads.heads)
        for part, values in (("loss", loss[k, :1]), ("gradient", gradient[k]))
        for at, value in enumerate(values)
    ]
    return spark.createDataFrame(rows, "head string, part string, coordinate bigint, value double")


@query("train_embedding_head")
def _(spark, sf):
    model = modelling.train_embedding_head(fx.table(spark, sf, "embeddings"))
    vectors = fx.table(spark, sf, "embeddings")
    features = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    scored = model.transform(features)
    return scored.select(
        F.col("vec_id").alias("id"),
        F.col("prediction").cast("int").alias("label"),
        F.array_max(vector_to_array("probability")).alias("score"),
    )


@query("score_batches")
def _(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    model = modelling.train_embedding_head(vectors)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def load_scorer():
        def top_probability(batch):
            logits = np.stack(batch["embedding"].to_numpy()) @ weights.T + bias
            exp = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (exp / exp.sum(axis=1, keepdims=True)).max(axis=1)

        return top_probability

    rows = vectors.select(F.col("vec_id").alias("id"), "embedding")
    return modelling.score_batches(rows, load_scorer)


@query(
    "score_batches_norm",
    """SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM embeddings""",
)
def _(spark, sf):
    def load_scorer():
        return lambda batch: np.linalg.norm(np.stack(batch["embedding"].to_numpy()).astype(np.float64), axis=1)

    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return modelling.score_batches(rows, load_scorer)
