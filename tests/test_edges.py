"""Broken labels, odd texts, degenerate scores, empty tables."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from textlens.functions import (
    bce_with_logits,
    binarise,
    focal_loss,
    hash_key,
    inject_keyword,
    is_missing,
    label_is_bad,
    n_ws_tokens,
    ngrams,
    parse_label,
    preview,
    quadrant,
    safe_ratio,
    seeded_uniform,
    sigmoid,
    uniform_exceeds,
    unlabelled_targets,
    word_tokens,
)
from textlens.operators import lexical, losses, metrics, profile, quality

ZEROS = [0.0] * 7


@pytest.mark.parametrize(
    ("text", "vector", "bad"),
    [
        ("[1, 0, 0, 1, 0, 0, 0]", [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0], False),
        (" [0,0,0,0,0,0,0] ", ZEROS, False),
        ("[1.0, 0]", [1.0, 0.0], True),
        ("[]", [], True),
        ("[1, 0", ZEROS, True),
        ("(1,0)", ZEROS, True),
        ("5", ZEROS, True),
        ("nan", ZEROS, True),
        ("", ZEROS, True),
        (None, ZEROS, True),
        ("[1,0] x", ZEROS, True),
        ("[1, null, 0, 0, 0, 0, 0]", ZEROS, True),
        ('["a", 0, 0, 0, 0, 0, 0]', ZEROS, True),
    ],
)
def test_labels(spark, text, vector, bad):
    df = spark.createDataFrame([(text,)], "label string")
    row = df.select(
        parse_label("label").alias("v"),
        label_is_bad("label").alias("bad"),
        binarise(parse_label("label")).alias("y"),
    ).first()
    assert (row.v, row.bad, row.y) == (vector, bad, int(sum(vector) > 0))
    assert quality.check_label_format(df).first().ok == (not bad)


TEXTS = [
    None,
    "",
    " \t\n ",
    "word",
    "?!... --",
    "Élan vital: naïve café, ÜBER straße",
    'He said "so"\tand\nleft_over 42 times',
    "one two three\x1ffour​five",
    "数字 １２３ и кириллица",
]


def test_tokens_as_in_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = df.select(
        "i", word_tokens("text").alias("words"), n_ws_tokens("text").alias("pieces")
    ).collect()
    for r in rows:
        text = TEXTS[r.i]
        assert r.words == (re.findall(r"\b\w+\b", text.lower()) if text is not None else [])
        assert r.pieces == (len(text.split()) if text is not None else None)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(ngrams("t", 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(ngrams("t", 1)).collect()] == [["a", "b", "c"], ["a"], []]
    with pytest.raises(ValueError):
        ngrams("t", 0)
    tokens = df.select(F.lit(1).alias("y"), F.col("t").alias("tokens"))
    for n, expected in ((1, 4), (2, 2), (3, 1), (4, 0)):
        assert lexical.explode_ngrams(tokens, n).count() == expected


def test_text_formatting(spark):
    df = spark.createDataFrame([("kw", "t" * 200), (None, None)], "k string, t string")
    rows = df.select(inject_keyword("k", "t").alias("a"), preview("t").alias("b")).collect()
    assert rows[0].a == "[kw] " + "t" * 200 and rows[0].b == "t" * 120
    assert rows[1].a == "[] " and rows[1].b is None
    missing = spark.createDataFrame([("NA",), ("x",), (None,)], "c string")
    flags = missing.select(is_missing("c").alias("a"), is_missing("c", ("NA",)).alias("b")).collect()
    assert [tuple(r) for r in flags] == [(False, True), (False, False), (True, True)]
    vector, y = unlabelled_targets(3)
    assert tuple(df.select(vector, y).first()) == ([-1.0] * 3, -1)


def test_losses_as_by_hand(spark):
    cases = [(x, y) for x in (-800.0, -3.0, 0.0, 0.4, 900.0) for y in (0, 1)]
    df = spark.createDataFrame(cases, "logit double, y int")
    rows = df.select(
        "logit",
        "y",
        bce_with_logits("logit", "y").alias("bce"),
        focal_loss("logit", "y").alias("focal"),
        focal_loss("logit", "y", gamma=0).alias("plain"),
        sigmoid("logit").alias("p"),
    ).collect()
    for r in rows:
        p = 1 / (1 + math.exp(-r.logit)) if r.logit > -700 else 0.0
        assert r.p == pytest.approx(p)
        signed = -r.logit if r.y else r.logit
        bce = signed if signed > 500 else math.log1p(math.exp(signed))
        assert r.bce == pytest.approx(bce, abs=1e-12)
        p_true = p if r.y else 1 - p
        assert r.focal == pytest.approx((1 - p_true) ** 2 * bce, abs=1e-12)
        assert r.plain == pytest.approx(bce, abs=1e-12)
    none = losses.reduce_focal_loss(df, reduction="none").agg(F.sum("focal_loss")).first()[0]
    assert losses.reduce_focal_loss(df, reduction="sum").first()[0] == pytest.approx(none)
    assert losses.reduce_focal_loss(df).first()[0] == pytest.approx(none / len(cases))
    with pytest.raises(ValueError):
        losses.reduce_focal_loss(df, reduction="median")


def test_small_functions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (3, 4), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [0.0, 0.0, 0.75, 0.0]
    pairs = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "y int, pred int")
    assert [r[0] for r in pairs.select(quadrant("y", "pred")).collect()] == ["TP", "FP", "FN", "TN"]
    u = spark.range(2000).select(seeded_uniform(42, F.col("id")).alias("u"))
    row = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("u")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.03 and row[3] == 2000
    value = u.filter("u > 0.4").first().u
    for p in (-1.0, 0.0, 0.1, value, 0.9999999999, 1.0, 2.0):
        same = spark.range(2000).filter(
            uniform_exceeds(hash_key(42, F.col("id")), p)
            != (seeded_uniform(42, F.col("id")) > p)
        )
        assert same.count() == 0


SCORED = "id bigint, keyword string, y int, pred int, score double, text string"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCORED)
    assert tuple(metrics.confusion_matrix(df).first()) == (0, 0, 0, 0)
    assert tuple(metrics.binary_metrics(df).first()) == (0.0, 0.0, 0.0, 0.0)
    assert metrics.average_precision(df).first()[0] == 0.0
    assert tuple(metrics.threshold_sweep(df).first()) == (0.5, 0.0)
    assert metrics.pr_curve(df).count() == 1
    assert metrics.hardest_false_positives(df).count() == 0
    assert metrics.predicted_positives(df).first().n_predicted == 0
    assert profile.class_distribution(df).first().imbalance_ratio == 0.0
    tokens = df.select("y", F.array().cast("array<string>").alias("tokens"))
    assert lexical.ngram_enrichment(tokens).count() == 0


def test_no_positives_and_all_tied(spark):
    negatives = spark.createDataFrame(
        [(i, "k", 0, 1, s, "t") for i, s in enumerate([0.2, 0.9, 0.9])], SCORED
    )
    assert metrics.average_precision(negatives).first()[0] == 0.0
    assert tuple(metrics.threshold_sweep(negatives).first()) == (0.5, 0.0)
    curve = [r for r in metrics.pr_curve(negatives).collect() if r.threshold is not None]
    assert {(r.precision, r.recall) for r in curve} == {(0.0, 1.0)}
    tied = spark.createDataFrame([(i, "k", i % 2, 1, 0.5, "t") for i in range(10)], SCORED)
    assert metrics.average_precision(tied).first()[0] == pytest.approx(0.5)
    assert metrics.threshold_sweep(tied).first().threshold == pytest.approx(0.05)
    hist = metrics.score_histogram(tied).collect()
    assert sorted((r.y, r.bin, r.n) for r in hist) == [(0, 0, 5), (1, 0, 5)]
    ends = spark.createDataFrame(
        [(1, "k", 1, 1, 1.0, "t"), (2, "k", 0, 0, 0.0, "t"), (3, "k", 0, 1, 0.95, "t")], SCORED
    )
    # 0.95 is the last grid point, so nothing separates the last two scores.
    assert metrics.threshold_sweep(ends).first().f1 == pytest.approx(2 / 3)


def test_null_group_and_null_length(spark):
    rows = [(1, "a", 1, 0, 4), (2, None, 1, 0, None), (3, "a", 0, 0, 2)]
    df = spark.createDataFrame(rows, "id bigint, keyword string, y int, pred int, n_ws_tokens int")
    assert [r.keyword for r in metrics.errors_by_group(df).collect()] == ["a"]
    by = {r.quadrant: r for r in metrics.length_by_quadrant(df).collect()}
    assert (by["FN"].mean_len, by["FN"].max_len) == (4.0, 4)


def test_enrichment_of_terms_without_negatives(spark):
    rows = [(1, ["x", "y", "z"]), (1, ["x", "y", "z"]), (0, ["p", "q", "r"])]
    df = spark.createDataFrame(rows, "y int, tokens array<string>")
    row = lexical.ngram_enrichment(df).first()
    assert (row.term, row.n_pos, row.n_neg) == ("x y z", 2, 0)
    assert row.ratio == pytest.approx(100.0 / 1e-6)
    rates = {r.term: r for r in lexical.ngram_rates(df, ["p q r", "absent"]).collect()}
    assert (rates["p q r"].n_neg, rates["p q r"].rate_neg) == (1, 100.0)
    assert (rates["absent"].n_pos, rates["absent"].n_neg) == (0, 0)
