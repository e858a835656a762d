"""The distributed optimiser: gradients, equality with other fits, epochs, cross-fitting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textlens.functions.scoring import sigmoid
from textlens.operators import gradient_fit, metrics, modelling, selection, training
from textlens.operators.gradient_fit import Head, Heads, Lbfgs, Shared, design, fit, gradient_sums, hashed_fold, margins
from textlens.operators.losses import combined_loss

SIZE = 12


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    true = rng.normal(size=(3, SIZE))
    out = []
    for i in range(300):
        ix = sorted(rng.choice(SIZE, rng.integers(0, 6), replace=False).tolist())
        val = rng.normal(size=len(ix)).round(3).tolist()
        z = true[:, ix] @ np.array(val) + rng.normal(size=3)
        out.append((i, Vectors.sparse(SIZE, ix, val), int(z[0] > 0.5), [float(z[1] > 0), float(z[2] > 1)], 0.5 + i % 3))
    return spark.createDataFrame(out, ["id", "features", "y", "label_vec", "weight"]).repartition(5, "id")


@pytest.fixture(scope="module")
def table(rows):
    return design(rows, "features", training.targets_of(), F.col("weight"), hashed_fold(4))


def value_at(table, objective, points):
    loss, gradient = gradient_sums(table, objective, points)
    total = [loss[k, 0] / loss[k, 1] + objective.penalty(k, points[k])[0] for k in range(len(objective))]
    return np.array(total), np.stack([g / loss[k, 1] + objective.penalty(k, points[k])[1] for k, g in enumerate(gradient)])


@pytest.mark.parametrize("objective", [
    Heads((Head("a", 0, 2.0), Head("b", 1, 0.0), Head("c", 2, 0.5, left_out=1)), SIZE),
    Shared(SIZE, 2, rank=3, gamma=2.0, label_weight=0.3),
    Shared(SIZE, 0, rank=2, gamma=1.0),
])
def test_gradient_by_differences(table, objective):
    rng = np.random.default_rng(1)
    points = np.stack([objective.start() + rng.normal(0, 0.5, objective.start().shape) for _ in range(len(objective))])
    _, slope = value_at(table, objective, points)
    move = rng.normal(size=points.shape)
    up, down = (value_at(table, objective, points + s * 1e-5 * move)[0] for s in (1, -1))
    assert np.allclose((up - down) / 2e-5, (slope * move).sum(axis=1), rtol=1e-6, atol=1e-8)


def test_sums_do_not_depend_on_blocks_or_tree(table, monkeypatch):
    objective = Heads((Head("a", 0, 2.0), Head("b", 1)), SIZE)
    points = np.random.default_rng(3).normal(size=(2, SIZE + 1))
    whole = gradient_sums(table, objective, points)
    monkeypatch.setattr(gradient_fit, "BLOCK", 5)
    monkeypatch.setattr(gradient_fit, "FAN_IN", 2)
    apart = gradient_sums(table, objective, points)
    again = gradient_sums(table, objective, points)
    assert np.allclose(whole[0], apart[0]) and np.allclose(whole[1], apart[1])
    assert (apart[1] == again[1]).all() and (apart[0] == again[0]).all()


def test_without_focus_it_is_weighted_logistic_regression(rows, table):
    objective = Heads((Head("y", reg=0.02),), SIZE)
    (state,) = fit(table, objective, 100, 1e-10)
    assert state.done and all(b <= a for a, b in zip(state.losses, state.losses[1:]))
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=0.02, standardization=False, maxIter=500, tol=1e-14).fit(rows)
    theirs = {r.id: r.p for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    ours = {r.id: r.p for r in margins(table, objective.weights([state.best])).select("id", sigmoid(F.col("margins")[0]).alias("p")).collect()}
    assert ours.keys() == theirs.keys() and max(abs(ours[i] - theirs[i]) for i in ours) < 1e-6


def test_joint_heads_are_separate_fits_in_one_scan_a_step(table, monkeypatch):
    scans = []
    real = gradient_fit.gradient_sums
    monkeypatch.setattr(gradient_fit, "gradient_sums", lambda *a: scans.append(1) or real(*a))
    heads = [Head("y", 0, 2.0), Head("l0", 1), Head("l1", 2, reg=0.1)]
    joint = fit(table, Heads(tuple(heads), SIZE), 60)
    together = len(scans)
    assert together == max(s.steps for s in joint)
    for head, state in zip(heads, joint):
        (alone,) = fit(table, Heads((head,), SIZE), 60)
        assert alone.steps == state.steps and (alone.best == state.best).all()


def test_reported_loss_is_the_combined_loss(spark, table):
    objective = Shared(SIZE, 2, rank=3, reg=0.0)
    (state,) = fit(table.withColumn("weight", F.lit(1.0)), objective, 60)
    assert state.losses[-1] < 0.7 * state.losses[0] and all(b <= a for a, b in zip(state.losses, state.losses[1:]))
    scored = margins(table, objective.weights([state.best]), "targets").select(
        F.col("margins")[0].alias("logit"), F.slice("margins", 2, 2).alias("label_logits"),
        F.col("targets")[0].alias("y"), F.slice("targets", 2, 2).alias("label_vec"))
    assert combined_loss(scored, 2.0, 0.3).first().combined_loss == pytest.approx(state.losses[-1], rel=1e-9)


def test_labels_shape_the_shared_head(table):
    def weights(label_weight):
        objective = Shared(SIZE, 2, rank=1, label_weight=label_weight)
        (state,) = fit(table, objective, 60)
        return objective.weights([state.best])[0]

    assert np.abs(weights(0.0) - weights(3.0)).max() > 0.05


def test_margin_heads_equal_a_plain_solver(table):
    """Squared hinge is quadratic for a given set of rows inside the margin: solve until it stays."""
    x, y, c = [], [], []
    for r in table.collect():
        row = np.zeros(SIZE + 1)
        row[r.ix], row[-1] = r.val, 1.0
        x.append(row)
        y.append(2 * r.targets[0] - 1)
        c.append(r.weight)
    x, y, c = np.array(x), np.array(y), np.array(c) / np.sum(c)
    regs = (0.01, 0.5)
    heads = tuple(Head(f"svm-{r}", reg=r, margin=True, gap=1e-9) for r in regs)
    for reg, state in zip(regs, fit(table, Heads(heads, SIZE), 200)):
        w = np.zeros(SIZE + 1)
        for _ in range(100):
            inside = y * (x @ w) < 1
            a = reg * np.eye(SIZE + 1) + 2 * (x[inside] * c[inside, None]).T @ x[inside]
            w = np.linalg.solve(a, 2 * x[inside].T @ (c * y)[inside])
        best = c @ np.maximum(0, 1 - y * (x @ w)) ** 2 + 0.5 * reg * w @ w
        assert state.done and -1e-12 < state.gap <= 1e-9
        assert state.loss == pytest.approx(best, abs=1e-8) and np.allclose(state.best, w, atol=1e-4)
    (rough,) = fit(table, Heads((Head("svm", reg=0.01, margin=True),), SIZE), 200)
    assert rough.done and rough.loss - fit(table, Heads(heads[:1], SIZE), 200)[0].loss <= rough.gap <= 1e-3


def test_cross_fit_equals_separate_fits(table):
    scores, states = training.cross_fit(table, SIZE, 4, (0.01, 0.5), gamma=2.0, steps=60)
    rows = {(r.id, r.run_id): r for r in scores.collect()}
    assert len(rows) == 600 and {r.fold for r in rows.values()} == {0, 1, 2, 3}
    for fold in (0, 3):
        rest = table.where(F.col("fold") != fold)
        (alone,) = fit(rest, Heads((Head("x", 0, 2.0, 0.5),), SIZE), 60)
        assert np.allclose(states[4 + fold].best, alone.best, atol=1e-6)
        held = margins(table.where(F.col("fold") == fold), np.stack([alone.best])).collect()
        assert held
        for r in held:
            assert rows[r.id, "run-1"].score == pytest.approx(1 / (1 + np.exp(-r.margins[0])), abs=1e-6)
    grid = metrics.threshold_sweep(scores.where("run_id = 'run-0'"))
    assert 0.05 <= grid.first().threshold <= 0.95


def test_a_killed_fit_goes_on_where_it_was(spark, rows, table, tmp_path, monkeypatch):
    dev = design(rows.where("id % 3 = 0"), "features", training.targets_of())
    objective = Heads((Head("a", 0, 2.0), Head("b", 0, 0.0, reg=1.0), Head("c", 1)), SIZE)
    options = dict(epochs=6, steps=2, patience=3)
    whole = training.train_epochs(table, dev, objective, **options)
    folder, real, calls = str(tmp_path / "fit"), training.advance, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(*args)

    monkeypatch.setattr(training, "advance", dies)
    with pytest.raises(RuntimeError, match="killed"):
        training.train_epochs(table, dev, objective, folder=folder, **options)
    calls[:] = [1] * 10
    resumed = training.train_epochs(table, dev, objective, folder=folder, **options)
    assert all((a == b).all() for a, b in zip(whole.points, resumed.points))
    assert sorted(map(tuple, whole.history.collect())) == sorted(map(tuple, resumed.history.collect()))
    again = training.train_epochs(table, dev, objective, folder=folder, **options)
    assert all((a == b).all() for a, b in zip(whole.points, again.points)) and len(calls) < 17
    with pytest.raises(ValueError, match="other runs"):
        training.train_epochs(table, dev, Heads((Head("x"), Head("y"), Head("z")), SIZE), folder=folder, **options)


def test_runs_end_by_the_rule(rows, table):
    dev = design(rows.where("id % 3 = 0"), "features", training.targets_of())
    result = training.train_epochs(table, dev, Heads((Head("a", 0, 2.0), Head("b", 1)), SIZE), epochs=12, steps=2, patience=2)
    history = result.history.withColumnRenamed("dev_f1", "f1")
    ends = {r.run_id: r for r in selection.early_stop(history, 2).collect()}
    last = {r.run_id: r.e for r in history.groupBy("run_id").agg(F.max("epoch").alias("e")).collect()}
    assert set(last) == {"a", "b"} and min(last.values()) < 12
    for run, end in ends.items():
        assert end.last_epoch == last[run] and (end.stop_epoch in (None, last[run]))
    kept = margins(dev, np.stack(result.points), "targets")
    for k, run in enumerate(("a", "b")):
        scored = kept.select((F.col("margins")[k] >= 0).cast("int").alias("pred"), F.col("targets")[k].cast("int").alias("y"))
        assert metrics.binary_metrics(scored).first().f1 == pytest.approx(ends[run].best_f1)


def test_awkward_rows(spark):
    empty, odd = Vectors.sparse(3, [], []), Vectors.dense([0.0, 1.0, 2.0])
    given = [(1, empty, 1, [1.0, 0.0]), (1, odd, 0, [0.0, 0.0]), (2, odd, None, [0.0, 1.0]), (3, odd, 1, None), (None, odd, 1, [1.0, 1.0]), (4, odd, 1, [1.0, None])]
    rows = spark.createDataFrame(given, ["id", "features", "y", "label_vec"]).withColumn("ix", F.lit("x")).withColumn("fold", F.lit(9))
    table = design(rows, "features", training.targets_of())
    assert sorted(r.id for r in table.collect()) == [1, 1]
    none = table.limit(0)
    (state,) = fit(none, Heads((Head("a"),), 3), 5)
    assert state.done and (state.best == 0).all()
    assert margins(none, np.zeros((1, 4))).count() == 0
    logits = {r.id: r.margins for r in margins(table.where("size(ix) = 3"), np.array([[1.0, 2.0, 3.0, 0.5]])).collect()}
    assert logits == {1: [8.5]}


def test_blocks_hold_what_rows_hold(spark, table, monkeypatch):
    """Rows without features, and one that is larger than a block; the sums are those of plain arrays."""
    monkeypatch.setattr(gradient_fit, "PACK_VALUES", 4)
    rows = table.collect()
    assert any(not r.ix for r in rows) and any(len(r.ix) > 4 for r in rows)
    blocks = gradient_fit.packed(table)
    assert set(blocks.dtypes) == {(c, "binary") for c in blocks.columns} and gradient_fit.packed(blocks) is blocks
    objective = Heads((Head("a", 0, 0.0), Head("b", 2, 0.0, left_out=1)), SIZE)
    points = np.random.default_rng(5).normal(size=(2, SIZE + 1))
    loss, gradient = gradient_sums(blocks, objective, points)
    for k, head in enumerate(objective.heads):
        total, sums = 0.0, np.zeros(SIZE + 1)
        for r in rows:
            w = 0.0 if r.fold == head.left_out else r.weight
            z = points[k, r.ix] @ np.array(r.val) + points[k, -1] if r.ix else points[k, -1]
            total += w * (np.logaddexp(0, z) - z * r.targets[head.target])
            for i, v in [*zip(r.ix, r.val), (SIZE, 1.0)]:
                sums[i] += w * (1 / (1 + np.exp(-z)) - r.targets[head.target]) * v
        assert loss[k, 0] == pytest.approx(total) and np.allclose(gradient[k], sums)
    margin = {tuple(r.targets): r.margins for r in gradient_fit.target_margins(blocks, points).collect()}
    assert len(margin) > 1 and gradient_fit.target_margins(blocks, points).count() == len(rows)


def test_a_vector_is_made_once(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0], 1)], "id long, x array<double>, y int")
    table = gradient_fit.design_rows(rows.withColumn("v", array_to_vector("x")), "v", training.targets_of(vector=None))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 1
    assert [(r.ix, r.val) for r in table.collect()] == [([0, 1], [0.0, 2.0])]


def test_text_models(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        bad = i % 4 == 0
        words = [rng.choice(["city", "road", "plan", "team"]) for _ in range(8)] + ["pity"] * bad + ["poor"] * (bad and i % 8 == 0)
        rng.shuffle(words)
        rows.append((i, None if i == 7 else " ".join(words), int(bad), [float(bad), float(bad and i % 8 == 0)]))
    df = spark.createDataFrame(rows, "id long, text string, y int, label_vec array<double>")
    for rank in (0, 3):
        model, losses = training.train_focal(df, 2, rank=rank, num_features=256, steps=25, reg=0.001)
        assert losses[-1] < 0.5 * losses[0]
        scored = {r.id: r.score for r in model.scores(df).collect()}
        assert len(scored) == 120 and min(scored[i] for i in range(0, 120, 4)) > max(scored[i] for i in range(120) if i % 4)
        labels = model.label_scores(df).join(df.select("id", "label_vec"), "id")
        predicted = labels.select(F.slice("label_vec", 1, 2).alias("label_vec"), F.transform(F.slice("label_scores", 2, 2), lambda s: (s >= 0.5).cast("double")).alias("pred_vec"))
        figures = {r.label: r.f1 for r in metrics.multilabel_metrics(predicted).collect()}
        assert figures["0"] == 1.0
    oof = training.cross_validated_text(df, 3, (0.001, 10.0), num_features=256, steps=20)
    best = selection.history_from_scores(oof.withColumn("epoch", F.lit(1)))
    assert selection.search_runs(best).first().run_id == "run-0"
    assert oof.count() == 240


def test_mllib_models_in_a_session_that_has_observed_metrics(spark):
    session = spark.newSession()
    session.range(3).observe(seen := Observation("seen"), F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    texts = session.createDataFrame(
        [(i, "good plan" if i % 2 else "poor road", i % 2, 1.0) for i in range(20)], "id long, text string, y int, weight double"
    )
    model = modelling.train_text_classifier(texts, num_features=64, max_iter=5)
    assert {r.id: r.score >= 0.5 for r in modelling.score_text(model, texts).collect()} == {i: i % 2 == 1 for i in range(20)}
    vectors = session.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(20)], "embedding array<float>, label int")
    head = modelling.train_embedding_head(vectors)
    scored = head.transform(vectors.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    assert all(r.prediction == r.label for r in scored.collect())


def test_optimiser_state_survives_bytes():
    state = Lbfgs(np.ones(4))
    scale = np.array([1.0, 10.0, 100.0, 0.1])
    for _ in range(60):
        if state.done:
            break
        state = Lbfgs.from_bytes(state.to_bytes())
        state.tell(0.5 * float(scale @ state.point**2), scale * state.point)
    assert state.done and np.abs(state.best).max() < 1e-5
