"""Fill-in-middle: the skip list against plain sums, outputs against a plain version."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm.middle_filling import SkipList, fill_in_middle, original, unit_list

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 10, 33, 500, 20_000])
def test_every_rank_is_reached_exactly(n):
    widths = np.array([random.Random(n).randint(1, 9) for _ in range(n)], np.int64)
    units = SkipList(widths)
    assert len(units) == n
    sums = np.append(0, np.cumsum(widths))
    for rank in range(n + 1) if n <= 500 else random.Random(1).sample(range(n + 1), 300):
        assert units.code_points_before(rank) == sums[rank]
    with pytest.raises(IndexError):
        units.code_points_before(n + 1)


def test_lanes_add_up():
    for units, widths, _ in unit_list("ab  cd é́ \n" * 5000).lanes:
        assert units.sum() == 15_001 and widths.sum() == 5000 * 11
    assert len(unit_list("a " * 100_000).lanes) > 8


def plain_version(text, key, seed=42):
    units = UNIT.findall(text or "")
    assert "".join(units) == (text or "")
    n, digits = len(units), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, text or "")
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_the_plain_version(docs):
    rng = random.Random(5)
    pieces = ["a", "be", "é", "🙂", " ", "  ", "\n", "\t\r", "\x0b", "\x85", "\xa0", "<", "S>", "<P", ">", "<P>", "<M>"]
    texts = [None, "", " ", "\n\n", "one", "<", "S>", "x" * 300_000, "wörd 🙂 " * 60_000]
    texts += ["".join(rng.choice(pieces[: rng.choice([9, 15, 15, 17])]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    ids = [None, None, 3, 3, *range(4, len(texts))]
    table = docs(texts, ids)
    for name in ("id", "n", "form", "output"):
        table = table.withColumn(name, F.lit("clash"))
    found = fill_in_middle(table).withColumn("back", original(F.col("output"), F.col("form")))
    rows = found.collect()
    assert rows[0].asDict().keys() == {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    got = sorted((str(r["doc_id"]), *map(str, r[1:6])) for r in rows)
    key = lambda i: "null" if i is None else str(i)
    assert got == sorted((str(i), *map(str, plain_version(t, key(i)))) for i, t in zip(ids, texts))
    by_id = {i: t or "" for i, t in zip(ids, texts) if i is not None and i > 3}
    assert all(r["back"] == by_id[r["doc_id"]] for r in rows if r["doc_id"] in by_id)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_rates_and_seed(spark, docs):
    table = docs(["a b c d e f"] * 4000)
    forms = {r["form"]: r["count"] for r in fill_in_middle(table).groupBy("form").count().collect()}
    assert 1850 < forms["plain"] < 2150 and 0.75 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.85
    none = fill_in_middle(table, percent=0).where("form <> 'plain'")
    psm = fill_in_middle(table, seed=7, percent=100, suffix_first=0).where("form = 'psm'")
    assert none.count() == 0 and psm.count() == 4000


def test_empty_table(docs):
    assert fill_in_middle(docs([])).collect() == []
