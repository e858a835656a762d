from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import jaccard_join
from textlens.llm.components import connected_components
from textlens.llm.jaccard_join import boundary, jaccard_components, list_keys, overlap_needed
from textlens.llm.shingles import fold, parities, shingle_sets


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] == rows[j][0]
            if None not in (rows[i][0], rows[j][0]) and (same or sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out.append((doc, len(sets[i]), None if doc is None else min(ids)))
    return sorted(out, key=str)


def make_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    shared = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "é É é", "a\x0bb\x1cc d", "a b\x1cc d"]
    base = [word() for _ in range(90)]
    for n in range(90):
        size = rng.choice([3, 5, 6, 8, 9, 11, 12, 13, 14, 20, 40, 90, 400])
        words = [word() for _ in range(size)]
        if n % 3 == 0:
            words = list(base[:size])
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
        if n % 7 == 0:
            words += shared
        texts.append(" ".join(words))
    return texts + texts[20:40]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    texts = make_texts(seed)
    ids = [*range(100, 100 + len(texts) - 6), None, None, 103, 120, 120, 121]
    got = jaccard_components(docs(texts, ids), list_cost=[2, 16][seed % 2]).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(list(zip(ids, texts)))


def test_group_of_near_copies_without_a_common_neighbour(docs):
    """A chain: each links with the next only."""
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(12):
        texts.append(" ".join(words))
        words[(5 * i) % 60] = f"n{i}"
    rows = list(enumerate(texts))
    got = jaccard_components(docs(texts)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(rows)


def test_round_of_pivots_without_a_pair_is_not_the_end(docs):
    """8 and 9 link with 10 alone, all in one list; the second pivot is 8 again."""
    rows = [(8, "a b c d e f g h p"), (9, "a b c d e f g h q"), (10, "a b c d e f g h")]
    got = jaccard_components(docs([t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(rows)


def test_empty_table(docs):
    assert jaccard_components(docs([])).count() == 0


def test_sets_that_link_share_a_key_and_pass_the_bounds():
    rng = np.random.default_rng(3)
    small = boundary()
    assert 5 <= small < 30
    for _ in range(400):
        n = int(rng.integers(1, 40))
        a = np.unique(rng.integers(0, 60, n).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(60, 90, rng.integers(0, 4)).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (ka, pa), (kb, pb) = list_keys(a, a, small), list_keys(b, b, small)
        room = len(a) + len(b) - 2 * overlap_needed(len(a), len(b))
        common = set(ka.tolist()) & set(kb.tolist())
        assert any(pa[list(ka).index(k)] + pb[list(kb).index(k)] <= room for k in common)
        assert int(np.bitwise_count(parities(a) ^ parities(b)).sum()) <= room
    a = rng.integers(0, 2**63, 5000).astype(np.uint64)
    for n in (4999, 4990, 4200, 4000):
        x, y = parities(a), parities(a[:n])
        assert int(np.bitwise_count(fold(x, len(y)) ^ y).sum()) <= 5000 - n


def test_long_text_is_read_whole():
    words = [f"w{i}" for i in range(300_000)]
    a, b = shingle_sets([" ".join(words).encode(), (" ".join(words[:-1]) + " other").encode()])
    assert len(a) == 299_996 and len(np.setdiff1d(a, b)) == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 101)}, **{1000 + i: 1000 for i in range(1, 200)}}


def test_counts_of_shingles_are_shuffled_a_part_at_a_time(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ADDED", 10)
    texts = [None, "", "a b", "a b", *(f"x{i % 7} one two three four five six y{i}" for i in range(40))]
    table = docs(texts).select(F.col("text").cast("binary").alias("text"))
    counts = jaccard_join.shingle_counts(table, 45)
    want = Counter(np.concatenate(list(shingle_sets([(t or "").encode() for t in texts]))).view(np.int64).tolist())
    assert {r["shingle"]: r["count"] for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning" in plan and ", 5)" in plan
    # a task holds no table of all its shingles: none is aggregated below the shuffle
    assert "Aggregate" not in plan[plan.rindex("Exchange"):]
    assert "Aggregate" in plan
