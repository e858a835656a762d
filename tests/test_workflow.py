"""From raw files to error tables on a small collection."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textlens import sources
from textlens.operators import metrics, selection, training
from textlens.plans import workflow


def test_whole_work_flow(spark, tmp_path):
    rng = random.Random(3)
    neutral = ["market", "city", "report", "year", "council", "team", "road", "plan"]
    loaded = ["poor", "helpless", "save", "mercy", "hopeless"]
    lines, labels = [], {"train": ["par_id,label"], "dev": ["par_id,label"]}
    for i in range(240):
        positive = rng.random() < 0.25
        words = [rng.choice(neutral) for _ in range(12)]
        if positive:
            words += [rng.choice(loaded) for _ in range(4)]
        rng.shuffle(words)
        lines.append(f"{i}\t@@{i}\tkw{i % 3}\tus\t{' '.join(words)}\t9")
        vector = [int(positive), 0, int(positive and i % 2 == 0)]
        labels["train" if i % 3 else "dev"].append(f'{i},"{vector}"')
    rng.shuffle(labels["train"])
    labels["train"].remove("par_id,label")
    labels["train"].insert(0, "par_id,label")

    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    raw = dict(
        corpus_path=write("corpus.tsv", "a\nb\nc\nd\n" + "\n".join(lines) + "\n"),
        label_paths={k: write(f"{k}.csv", "\n".join(v) + "\n") for k, v in labels.items()},
        unlabelled_path=write("test.tsv", "900\t@@1\tkw0\tus\tsave the poor helpless\n901\t@@2\tkw1\tgb\tcity plan\n"),
        out_dir=str(tmp_path / "splits"),
    )
    workflow.prepare(spark, **raw)
    report = workflow.verify(spark, **raw, width=3).collect()
    assert len(report) == 1 + 2 * 5 + 2
    assert [r for r in report if not r.ok] == []

    read = {n: sources.read_split(spark, f"{raw['out_dir']}/{n}") for n in ("train", "dev")}
    order = [line.split(",")[0] for line in labels["train"][1:]]
    assert [r.id for r in read["train"].collect()] == order

    splits = {n: workflow.labelled(df, 3) for n, df in read.items()}
    tokens = workflow.tokenised(splits["train"])
    tables = workflow.profile_tables(splits["train"], tokens, ["the", "a"])
    assert tables["class_distribution"].first().n_total == 160
    assert all(t.count() > 0 for t in tables.values())
    words = {r.term for r in tables["distinctive_words"].filter("only_pos").collect()}
    assert words <= set(loaded)

    training = workflow.train(
        splits["train"], splits["dev"], reg_params=(0.01, 1.0), n_aug=1, num_features=1 << 10, max_iter=10
    )
    assert training.history.count() == 2
    dev = workflow.predict([training.model], splits["dev"], training.threshold)
    names = ("unequal", "shallow", "pity")
    report = workflow.evaluate(splits["dev"], dev, names)
    summary = {r.metric: r.value for r in report["summary"].collect()}
    assert summary["n"] == 80 and summary["f1"] > 0.8 and summary["average_precision"] > 0.8
    assert summary["f1"] == metrics.binary_metrics(splits["dev"].join(dev, "id")).first().f1
    assert {r.label for r in report["errors_by_label"].collect()} == set(names)
    assert all(t.columns for t in report.values())

    test = sources.read_split(spark, f"{raw['out_dir']}/test", labelled=False)
    scored = {r.id: r.score for r in workflow.predict([training.model] * 2, test, training.threshold).collect()}
    assert scored["900"] > scored["901"]
    numbered = sources.read_split(spark, f"{raw['out_dir']}/test", labelled=False, row_ids=True)
    predictions = workflow.predict([training.model], test, training.threshold)
    workflow.write_prediction_file(predictions, numbered, str(tmp_path / "test.txt"))
    lines = sources.read_predictions(spark, str(tmp_path / "test.txt")).orderBy("row_id").collect()
    decided = {r.id: r.pred for r in predictions.collect()}
    assert [r.pred for r in lines] == [decided["900"], decided["901"]]
    with pytest.raises(Exception, match="no prediction"):
        workflow.write_prediction_file(predictions.limit(1), numbered, str(tmp_path / "short.txt"))


def test_training_with_draws_epochs_and_label_heads(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        bad = i % 5 == 0
        words = [rng.choice(["market", "city", "report", "road"]) for _ in range(8)] + ["pity"] * bad + ["poor"] * (bad and i % 2)
        rows.append((str(i), "kw", " ".join(words), int(bad), [float(bad), float(bad and i % 2)]))
    df = spark.createDataFrame(rows, "id string, keyword string, text string, y int, label_vec array<double>")
    parts = df.where("int(id) % 3 > 0"), df.where("int(id) % 3 = 0")
    options = dict(reg_params=(0.0001, 1.0), num_features=1 << 8, max_iter=4, epochs=5, patience=2, draws=True, width=2, label_reg=0.001, n_aug=1)
    result = workflow.train(*parts, folder=str(tmp_path / "state"), **options)
    again = workflow.train(*parts, folder=str(tmp_path / "state"), **options)  # goes on behind the last epoch
    assert sorted(result.history.collect()) == sorted(again.history.collect())
    epochs = {r.run_id: r.n for r in result.history.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert set(epochs) == {"run-0", "run-1"} and max(epochs.values()) > 1

    workflow.write_training(result, str(tmp_path / "out"))
    read = workflow.read_training(spark, str(tmp_path / "out"))
    assert sorted(read["history"].select(result.history.columns).collect()) == sorted(result.history.collect())
    best = selection.search_runs(read["history"].withColumnRenamed("dev_f1", "f1"), 2).first()
    assert best.run_id == result.model.names[0] and best.best_f1 == 1.0
    assert read["threshold"].first().threshold == result.threshold.first().threshold
    scores = read["dev_scores"].join(parts[1].select("id", "y"), "id")
    assert metrics.threshold_sweep(scores).first().threshold == result.threshold.first().threshold
    figures = {r.label: r.f1 for r in workflow.evaluate_labels(result.label_model, parts[1]).collect()}
    assert figures["0"] == 1.0 and set(figures) == {"0", "1", "micro", "macro"}


def test_prediction_file_has_a_line_for_every_row(spark, tmp_path):
    df = spark.createDataFrame([("a", "k", "pity"), ("a", "k", "city"), (None, "k", "pity"), ("b", "k", None)], "id string, keyword string, text string")
    split = df.coalesce(1).withColumn("row_id", F.monotonically_increasing_id())
    train = spark.createDataFrame([(i, "pity" if i % 2 else "city", i % 2) for i in range(20)], "id long, text string, y int")
    model, _ = training.train_focal(train.withColumn("label_vec", F.array(F.lit(0.0))), 1, num_features=64, steps=10)
    threshold = spark.createDataFrame([(0.5,)], "threshold double")
    predictions = workflow.predict([model], split, threshold)
    check = workflow.write_prediction_file(predictions, split, str(tmp_path / "p.txt")).first()
    assert (check.expected, check.actual, check.ok) == (4, 4, True)
    assert [r.pred for r in sources.read_predictions(spark, str(tmp_path / "p.txt")).orderBy("row_id").collect()][:3] == [1, 0, 1]
    assert not workflow.write_prediction_file(predictions, split, str(tmp_path / "q.txt"), expected_rows=5).first().ok
