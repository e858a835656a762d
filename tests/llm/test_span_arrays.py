"""Blocked folds, pieces of texts and sweeps against plain Python; a text with very many spans."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from textlens.llm import span_arrays
from textlens.llm.pii_spans import find_personal_data, redact, with_candidates
from textlens.llm.span_arrays import chunks, clear_of, piece, running

SPANS = "array<struct<kind: int, start: int, end: int>>"


def test_running(spark):
    rng = random.Random(1)
    lists = [[rng.randint(-5, 9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 512, 1000)]
    df = spark.createDataFrame([(v,) for v in lists], "v array<int>")
    got = df.select("v", running(F.col("v"), lambda a, b: a + b, 0).alias("s"), running(F.col("v"), F.greatest, 3).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
        assert r.m == [max([3, *r.v[:i]]) for i in range(len(r.v))]


def test_pieces(spark):
    rng = random.Random(2)
    texts = ["", "x", "a🙂é\n" * 400, "🙂" * 512, "🙂" * 513 + "\n\r"]
    rows = [(t, a, a + rng.choice([0, 1, 30, 700])) for t in texts for a in [0, 1, 511, 512, 513, *(rng.randint(0, 1700) for _ in range(20))] if a <= len(t)]
    df = spark.createDataFrame(rows, "t string, a int, b int")
    for r in df.select("*", piece(chunks(F.col("t")), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == r.t[r.a : r.b], (r.a, r.b)


def some_spans(rng, n, length):
    out = []
    for _ in range(n):
        start = rng.randint(0, length - 2)
        out.append((rng.randint(0, 3), start, min(length, start + rng.randint(1, 9))))
    return out


def test_clear_of_and_redact(spark, monkeypatch):
    monkeypatch.setattr(span_arrays, "BLOCK", 4)
    rng = random.Random(3)
    text = "".join(rng.choice("abc🙂\n") for _ in range(60))
    rows = [(text, some_spans(rng, rng.randint(0, 12), 60), some_spans(rng, rng.randint(0, 6), 60)) for _ in range(200)]
    df = spark.createDataFrame(rows, f"t string, mine {SPANS}, others {SPANS}")
    got = df.select("*", clear_of(F.col("mine"), F.col("others")).alias("c"), redact(F.col("t"), F.col("mine")).alias("r")).collect()
    names = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>"]
    for r in got:
        want = [s for s in r.mine if not any(o.start < s.end and s.start < o.end for o in r.others)]
        assert sorted((s.start, s.end, s.kind) for s in r.c) == sorted((s.start, s.end, s.kind) for s in want)
        out, at = "", 0
        for s in sorted(r.mine, key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += r.t[at : s.start] + names[s.kind]
            at = max(at, s.end)
        assert r.r == out + r.t[at:]


def test_text_with_very_many_spans(spark, docs):
    """80,000 addresses in one text, four times as many as 20,000: not sixteen times the time."""
    line = "write to a.b%d@mail.example.org or 10.0.0.%d now é\n"
    texts = {n: "".join(line % (i, i % 256) for i in range(n // 2)) for n in (20_000, 80_000)}
    took = {}
    for n in (20_000, 80_000):
        start = time.perf_counter()
        (row,) = find_personal_data(docs([texts[n]])).collect()
        took[n] = time.perf_counter() - start
        assert len(row.base_spans) == n
        for s in random.Random(n).sample(row.base_spans, 200):
            assert texts[n][s.start : s.end].startswith("10." if s.kind == 1 else "a.b")
    assert took[80_000] < 90
    (hidden,) = find_personal_data(docs([texts[20_000]])).select(redact(F.lit(texts[20_000]), F.col("spans")).alias("t")).collect()
    assert hidden.t.count("<EMAIL>") == hidden.t.count("<IP>") == 10_000 and "@" not in hidden.t
    print(took)


def test_the_driver_computes_no_lower_case(spark):
    df = spark.createDataFrame([("Ab" * 9, 2, 4)], "t string, a int, b int").repartition(1)
    low = df.select(F.lower(piece(chunks(F.col("t")), F.col("a"), F.col("b"))).alias("p"))
    assert "THEN lower(" not in low._jdf.queryExecution().optimizedPlan().toString()
    assert low.first().p == "ab"


def test_candidates_are_a_plan_of_few_steps(docs):
    found = with_candidates(docs(["mail a@b.example.org, +49 30 1234567 or a (at) b (dot) org", "", None]))
    assert found._jdf.queryExecution().analyzed().toString().count("Project [") <= 8
    assert [(len(r.pii_base), len(r.pii_more)) for r in found.collect()] == [(2, 2), (0, 0), (0, 0)]
