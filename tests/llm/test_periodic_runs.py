"""Periodic runs against every diagonal tried word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textlens.llm import queries
from textlens.llm.periodic_runs import longest_run, periodic_runs, runs_text, text_runs, with_repeats
from tests.llm.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(words):
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(6, 4 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                runs.append((i, len(run), q))
            i = j
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {x for start, length, q in runs for x in range(start + q, start + length)}
    return runs, [w for i, w in enumerate(words) if i not in gone]


def planted(words, key):
    n, h = len(words), zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 9))]
        words += block * rng.randint(1, 6)
    return words


@pytest.mark.parametrize("seed", range(10))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(100):
        texts = [" ".join(repetitive(rng)) for _ in range(rng.randint(1, 5))]
        assert text_runs(texts) == [brute_force(t.split()) for t in texts]


def test_shapes_that_are_easy_to_miss():
    six, fibonacci = "x " * 6, ["a", "ab"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [six, "x " * 5, "a b " * 4, "a b " * 3 + "a", "a b c a b d " * 4, ("a b a b a b a b c " * 5), " ".join(fibonacci[-1])]
    assert text_runs(texts) == [brute_force(t.split()) for t in texts]
    assert text_runs(texts)[0] == ([(0, 6, 1)], ["x"])


def test_long_periodic_texts_are_linear():
    """A million equal words, and a period of 60,000 words: each is one run."""
    long = " ".join(f"w{i}" for i in range(60_000))
    assert text_runs(["x " * 1_000_000])[0] == ([(0, 1_000_000, 1)], ["x"])
    assert text_runs([" ".join([long] * 5)])[0] == ([(0, 300_000, 60_000)], long.split(" "))


def test_awkward_rows(spark, docs):
    texts = [None, "", " \n", "one", "x\x85 " * 8, "a\tb\x0b" * 5 + "A b", "same " * 7, "same " * 7, "é à " * 4]
    ids = [1, None, None, 3, 4, 5, 6, 6, 7]
    table = docs(texts, ids)
    for name in ("id", "runs", "collapsed", "start"):
        table = table.withColumn(name, F.lit(1))
    rows = periodic_runs(table).collect()
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows)
    expected = [(str(i), *brute_force(WORD.findall(t or ""))) for i, t in zip(ids, texts)]
    assert got == sorted((i, runs, " ".join(kept)) for i, runs, kept in expected)


def test_empty_table(docs):
    assert periodic_runs(docs([])).collect() == []


def test_ties_of_the_longest(spark):
    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    rows = spark.createDataFrame([([(9, 8, 1), (2, 8, 2), (2, 8, 1), (0, 7, 1)],), ([],)], f"runs {runs}")
    best = rows.select(longest_run(F.col("runs")).alias("b"), runs_text(F.col("runs")).alias("t")).collect()
    assert tuple(best[0]["b"]) == (2, 8, 1) and best[1]["b"] is None
    assert best[0]["t"] == "9,8,1\n2,8,2\n2,8,1\n0,7,1\n" and best[1]["t"] == ""


def test_repeats_are_planted_by_the_rule(spark, docs):
    rng = random.Random(3)
    texts = [" ".join(f"w{i}" for i in range(rng.randint(0, 60))) for _ in range(400)] + [None, "\n"]
    table = docs(texts)
    rows = table.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert {r["doc_id"]: WORD.findall(r["t"]) for r in rows} == {i: planted(WORD.findall(t or ""), i) for i, t in enumerate(texts)}


def test_query_equals_brute_force(spark, small):
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    given = small("documents").select("doc_id", "text").collect()
    assert len(rows) == len(given)
    for key, text in given:
        words = planted(WORD.findall(text or ""), key)
        if len(words) > 3000:  # brute force is quadratic; long ones have tests of their own
            continue
        runs, kept = brute_force(words)
        start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        assert rows[key].asDict() == {
            "doc_id": key, "n_runs": len(runs), "start": start, "length": length, "period": q,
            "exponent_milli": 1000 * length // q if runs else None,
            "runs_sha256": sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), "collapsed_sha256": sha(" ".join(kept)),
        }
