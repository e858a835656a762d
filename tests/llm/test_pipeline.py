"""Each stage against a plain version over the stage's own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import SMALL
from tests.llm.test_jaccard import brute
from tests.llm.test_text_operators import base_spans
from textlens.llm.common import store


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = store(stage(spark, docs, SMALL), name)
        out.append((docs, after))
        docs = after
    return {name: pair for (name, _), pair in zip(P.STAGES, out)}


def test_columns(tables):
    for name, (before, after) in tables.items():
        assert sorted(before.columns) == sorted(P.COLUMNS)
        assert name == "packing" or sorted(after.columns) == sorted(P.COLUMNS)


def test_quality_keeps_good_documents(spark, tables):
    before, after = tables["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in after.collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i, q in marked.items() if q == 1]
    bad = [i for i, q in marked.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    assert after.join(before, list(P.COLUMNS), "left_anti").count() == 0


def test_one_of_each_group_stays(tables):
    before, after = tables["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in groups})


def test_personal_data_is_gone(tables):
    before, after = tables["personal_data"]
    assert before.count() == after.count()
    for r in after.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)


def test_mix_repeats_at_most_three_times(tables):
    before, after = tables["mixing"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert after.join(before, list(P.COLUMNS), "left_anti").count() == 0


def test_pieces_cover_the_mix(tables):
    before, after = tables["packing"]
    assert after.where("start = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_awkward_documents(spark, docs):
    made = docs([None, "", "x", "plain words of a text " * 9, "plain words of a text " * 9, "y" * 9000], [1, None, 2, 3, 3, None]).select(*P.COLUMNS)
    for _, stage in P.STAGES[:-1]:
        made = store(stage(spark, made, SMALL), "awkward")
        assert sorted(made.columns) == sorted(P.COLUMNS)
    P.STAGES[-1][1](spark, made, SMALL).count()
    none = docs([]).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, none, SMALL).count() == 0
