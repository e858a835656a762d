"""Files: preamble, quoting, row order, round trips."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from textlens import sources
from textlens.operators import joins, modelling, quality

PREAMBLE = "This corpus is for research.\nDo not share.\n\tIndented\n----\n"


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corpus_with_preamble_and_quotes(spark, tmp_path):
    path = _write(
        tmp_path / "corpus.tsv",
        PREAMBLE
        + "1\t@@7\thomeless\tus\tPlain text .\t0\n"
        + '2\t@@8\tin-need\tgb\t"Quoted ""so"" and a\ttab"\t1\n'
        + "3\t@@9\twomen\tNA\t\t0\n",
    )
    rows = {r.id: r for r in sources.read_corpus_tsv(spark, path).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert rows["1"].text == "Plain text ." and rows["1"].art_id == "@@7"
    assert rows["2"].text == 'Quoted "so" and a\ttab'
    assert rows["3"].text is None and rows["3"].country == "NA"
    named = sources.read_corpus_tsv(spark, path, na_values=["NA"])
    assert named.filter("id = '3'").first().country is None


def test_preamble_is_skipped_in_each_file_and_only_there(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(3):
        lines = "".join(f"{f * 1000 + i}\ta\tk\tus\ttext {i}\t0\n" for i in range(500))
        _write(folder / f"part-{f}.tsv", PREAMBLE + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        corpus = sources.read_corpus_tsv(spark, str(folder))
        assert corpus.count() == 1500
        assert corpus.filter("id IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_corpus_without_quoting_and_bad_rows(spark, tmp_path):
    path = _write(tmp_path / "c.tsv", '1\ta\tk\tus\t"half quoted\t0\nx\ta\tk\tus\tt\t0\n')
    plain = sources.read_corpus_tsv(spark, path, skip=0, quote="\0", keep_corrupt=True)
    rows = plain.orderBy(F.col("id").asc_nulls_last()).collect()
    assert rows[0].text == '"half quoted'
    assert [r.id for r in rows] == ["1", "x"]


def test_corpus_with_line_breaks(spark, tmp_path):
    path = _write(tmp_path / "m.tsv", PREAMBLE + '1\ta\tk\tus\t"two\nlines"\t0\n2\ta\tk\tus\tone\t0\n')
    rows = sources.read_corpus_tsv(spark, path, multi_line=True).orderBy("id").collect()
    assert [r.text for r in rows] == ["two\nlines", "one"]


def test_labels_and_unlabelled(spark, tmp_path):
    labels = _write(tmp_path / "l.csv", 'par_id,label\n5,"[1, 0]"\n3,"[0, 0]"\n')
    rows = sources.read_labels_csv(spark, labels, row_ids=True).orderBy("row_id").collect()
    assert [(r.row_id, r.id, r.label) for r in rows] == [(0, "5", "[1, 0]"), (1, "3", "[0, 0]")]
    test = _write(tmp_path / "t.tsv", "t_1\ta\tk\tus\tx\n7\ta\tk\tus\ty\n")
    assert [r.id for r in sources.read_unlabelled_tsv(spark, test).collect()] == ["t_1", "7"]


def test_as_many_predictions_as_lines(spark, tmp_path):
    """Keys that are no numbers reach the prediction file."""
    lines = [f"t_{i}\ta\tk\tus\ttext {i}\n" for i in range(5)]
    test = sources.read_unlabelled_tsv(spark, _write(tmp_path / "t.tsv", "".join(lines)))
    scores = test.select("id", F.lit("m").alias("model_id"), (F.length("id") / 10.0).alias("score"))
    threshold = spark.range(1).select(F.lit(0.2).alias("threshold"))
    got = modelling.predict_split(scores, threshold).collect()
    assert sorted((r.id, r.pred) for r in got) == [(f"t_{i}", 1) for i in range(5)]


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_split_round_trip(spark, tmp_path, format):
    rows = [
        (4, 1, "a", "k", "us", 'say "hi",\nthen\tgo', "[1]"),
        (2, 0, None, None, "gb", None, "[0]"),
        (9, 2, "b", "k,x", "de", "déjà vu", "[0]"),
    ]
    names = "id bigint, row_id bigint, art_id string, keyword string, country string, text string, label string"
    df = spark.createDataFrame(rows, names).repartition(3)
    path = str(tmp_path / "split")
    sources.write_split(df, path, format, row="row_id")
    back = sources.read_split(spark, path, format, row_ids=True).orderBy("row_id").collect()
    assert [r.id for r in back] == ["2", "4", "9"]
    assert [r.text for r in back] == [None, 'say "hi",\nthen\tgo', "déjà vu"]
    assert [r.art_id for r in back] == [None, "a", "b"]


def test_predictions_keep_their_order(spark, tmp_path):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("row_id"), ((F.col("id") * 7) % 3 == 0).cast("int").alias("pred"))
    path = str(tmp_path / "pred")
    sources.write_predictions(df.orderBy(F.rand(3)), path)
    lines = [
        line.strip() for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part)
    ]
    assert lines == [str(int(i * 7 % 3 == 0)) for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        back = {r.row_id: r.pred for r in sources.read_predictions(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert back == {i: int(i * 7 % 3 == 0) for i in range(n)}
    assert quality.check_expected_rows(df, n).first().ok
    assert not quality.check_expected_rows(df, n + 1).first().ok


def test_predictions_of_one_file_in_many_splits(spark, tmp_path):
    path = _write(tmp_path / "dev.txt", "".join(f"{int(i % 5 == 0)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "501")
    try:
        rows = sources.read_predictions(spark, path).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_id, r.pred) for r in rows] == [(i, int(i % 5 == 0)) for i in range(3000)]


def test_numbering_beyond_the_broadcast_limit(spark, tmp_path, monkeypatch):
    from textlens.sources import readers

    path = _write(tmp_path / "dev.txt", "".join(f"{i % 2}\n" for i in range(1000)))
    small = readers.read_predictions(spark, path)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(readers, "_MAX_BROADCAST_SPLITS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = readers.read_predictions(spark, path)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(large.collect()) == sorted(small.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_alignment_by_position(spark, tmp_path):
    split = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "row_id bigint, text string")
    predictions = spark.createDataFrame([(i, i % 2) for i in range(4)], "row_id bigint, pred int")
    scores = spark.createDataFrame([(i, i / 10) for i in range(4)], "row_id bigint, score double")
    rows = joins.align_by_position(split, predictions, scores).orderBy("row_id").collect()
    assert [(r.text, r.pred, r.score) for r in rows] == [(f"text {i}", i % 2, i / 10) for i in range(4)]
    with pytest.raises(Exception, match="differ in length at row 3"):
        joins.align_by_position(split, predictions.filter("row_id < 3")).collect()


def test_scores_history_threshold(spark, tmp_path):
    scores = spark.createDataFrame([("t_1", "a", 0.25)], "id string, model_id string, score double")
    sources.write_scores(scores, str(tmp_path / "s"))
    assert sources.read_scores(spark, str(tmp_path / "s")).collect() == scores.collect()

    history = spark.createDataFrame(
        [(2, 0.1, 0.5, 0.6, 0.4), (1, 0.2, 0.4, 0.5, 0.3)],
        "epoch bigint, loss double, dev_f1 double, dev_p double, dev_r double",
    )
    sources.write_history(history, str(tmp_path / "h"))
    assert sources.read_history(spark, str(tmp_path / "h")).collect() == history.orderBy("epoch").collect()
    pretty = _write(
        tmp_path / "h.json",
        '[\n  {\n    "epoch": 1,\n    "loss": 0.2,\n    "dev_f1": 0.4,\n    "dev_p": 0.5,\n    "dev_r": 0.3\n  }\n]',
    )
    assert sources.read_history(spark, pretty).collect() == history.filter("epoch = 1").collect()

    threshold = spark.createDataFrame([(0.47,)], "threshold double")
    sources.write_threshold(threshold, str(tmp_path / "t"))
    assert sources.read_threshold(spark, str(tmp_path / "t")).first().threshold == 0.47
    assert sources.read_threshold(spark, str(tmp_path / "none"), 0.3).first().threshold == 0.3
    assert "".join(open(f).read() for f in glob.glob(str(tmp_path / "t/part-*"))) == "0.4700\n"


def test_report_tables(spark, tmp_path):
    table = spark.createDataFrame([("The Poorer, the Merrier", 6)], "label string, fn int").coalesce(1)
    sources.write_report_tables({"by_label": table}, str(tmp_path))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "by_label/part-*")))
    assert text == 'label,fn\n"The Poorer, the Merrier",6\n'


def test_prepare_and_verify(spark, tmp_path):
    corpus = sources.read_corpus_tsv(
        spark,
        _write(
            tmp_path / "c.tsv",
            PREAMBLE + "".join(f"{i}\ta{i}\tk\tus\ttext {i}\t9\n" for i in range(20)),
        ),
    )
    labels = sources.read_labels_csv(
        spark,
        _write(tmp_path / "l.csv", "par_id,label\n" + "".join(f'{i},"[{i % 2}]"\n' for i in (7, 3, 11))),
        row_ids=True,
    )
    columns = ["id", "art_id", "keyword", "country", "text", "label"]
    split = joins.attach_text(labels, corpus).select("row_id", *columns)
    path = str(tmp_path / "train")
    sources.write_split(split, path, "csv", row="row_id")
    back = sources.read_split(spark, path, "csv")
    assert [r.id for r in back.collect()] == ["7", "3", "11"]
    assert {r.label for r in back.collect()} == {"[1]"}
    report = quality.quality_report(
        quality.check_row_count(labels, back),
        quality.check_columns(back, columns),
        quality.check_missing(labels, corpus),
        quality.check_unique_key(corpus, "id"),
        quality.check_label_format(back, 1),
        quality.content_check(
            quality.check_content(back, labels.drop("row_id"), corpus, "id", columns[1:])
        ),
    )
    assert [r for r in report.collect() if not r.ok] == []


def test_missing_value_spellings_and_runs(spark, tmp_path):
    labels = sources.read_labels_csv(spark, _write(tmp_path / "l.csv", 'par_id,label\n1,"[1]"\n2,NA\n'), na_values=("NA",))
    assert [r[1] for r in labels.collect()] == ["[1]", None]
    runs = spark.createDataFrame(
        [("a/b", 2, 0.1, 0.5, 0.6, 0.4), ("a/b", 1, 0.2, 0.4, 0.5, 0.3), ("c", 1, 0.3, 0.0, 0.0, 0.0)],
        "run_id string, epoch bigint, loss double, dev_f1 double, dev_p double, dev_r double",
    )
    sources.write_history(runs, str(tmp_path / "runs"))
    assert sorted(sources.read_history(spark, str(tmp_path / "runs")).collect()) == sorted(runs.collect())
