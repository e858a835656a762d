from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlens.llm import topk_search
from textlens.llm.topk_search import segment_bounds, top_k_products
from textlens.llm.vector_neardup import near_duplicate_vectors, quantise, upper_bounds

SCHEMA = "vec_id long, embedding array<float>, label int, one string"


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64)) * rng.choice([1, 100], size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (upper_bounds(quantise(x), quantise(x)) >= x @ x.T).all()
    assert np.abs(upper_bounds(quantise(x), quantise(x)) - x @ x.T).max() < 0.2
    for n in (1, 4, 16, 64):
        assert (segment_bounds(x, n) @ segment_bounds(x, n).T + 1e-9 >= x @ x.T).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        base = rng.normal(size=8) if i % 3 else rows[i // 2][1] if rows and rows[i // 2][1] else rng.normal(size=8)
        v = [float(np.float32(a)) for a in np.array(base) + (rng.normal(size=8) * 0.05 if i % 6 else 0)]
        rows.append((i, v, i % 2 if i % 17 else None, "x"))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [nan] * 8, [inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 3, [1.0] * 3, [1e30] * 8, [1e30] * 8]
    rows += [(200 + i, v, 1, "x") for i, v in enumerate(odd)] + [(None, [1.0] * 8, 1, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def usable(v):
    return bool(v) and all(a is not None and np.isfinite(a) for a in v)


def test_near_duplicates_equal_brute_force(vectors):
    rows, df = vectors
    good = {i: (np.array(v, np.float64), l) for i, v, l, _ in rows if i is not None and l is not None and usable(v) and any(v)}
    links = {i: set() for i in good}
    for a in good:
        for b in good:
            x, y = good[a][0], good[b][0]
            if a != b and good[a][1] == good[b][1] and len(x) == len(y):
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a].add(b)
    for tile in (4, 2048):
        got = {r.vec_id: r for r in near_duplicate_vectors(df, tile_rows=tile).collect()}
        assert len(got) == len(rows)
        for i, _, _, _ in rows:
            seen, todo = {i}, [i]
            while todo:
                new = links.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            if i is None:
                assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, None, False)
            else:
                assert (got[i].n_links, got[i].component_id) == (len(links.get(i, ())), min(seen)), i
                assert got[i].kept == (min(seen) == i)


def test_top_k_equals_brute_force(vectors):
    rows, df = vectors
    good = {i: np.floor(64 * np.array(v, np.float64)).astype(object) for i, v, _, _ in rows if i is not None and usable(v) and i < 208}
    df = df.where("vec_id < 208")
    got = {}
    for r in top_k_products(df, F.col("vec_id") % 20 == 0, k=5, candidate_block=40, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-int(good[q] @ good[x]), x) for x in good if x != q and len(good[x]) == len(good[q]))[:5]
            if scored:
                want[q] = [(k, x, -s) for k, (s, x) in enumerate(scored, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_of_repeated_rows(spark):
    """Each row is a candidate of every other, also of one with its own id."""
    rng = np.random.default_rng(4)
    base = [[float(np.float32(a)) for a in rng.normal(size=4)] for _ in range(4)]
    rows = [(i % 21, base[i % 4 if i % 21 else i % 2], 1, "x") for i in range(60)] + [(0, base[0], 1, "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(7)).withColumn("query_row", F.lit(7))
    got = top_k_products(df, F.col("vec_id") % 20 == 0, k=6, candidate_block=10, query_block=2).collect()
    want = []
    for n, (q, v, _, _) in enumerate(rows):
        if q % 20 == 0:
            x = np.floor(64 * np.array(v))
            scored = sorted((-int(x @ np.floor(64 * np.array(w))), c) for m, (c, w, _, _) in enumerate(rows) if m != n)
            want += [(q, k, c, -s) for k, (s, c) in enumerate(scored[:6], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    three = spark.createDataFrame([(0, base[0], 1, "x"), (1, base[1], 1, "x"), (1, base[1], 1, "x"), (2, base[2], 1, "x")], SCHEMA)
    assert [r.vec_id for r in top_k_products(three, F.col("vec_id") % 20 == 0).orderBy("rank").collect()].count(1) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_vectors(none).count() == 0
    assert top_k_products(none, F.col("vec_id") % 20 == 0).count() == 0


def test_block_with_more_candidates_than_a_step():
    """A query's own row is left out in every step, also when a step finds queries of fewer rows."""
    rng = np.random.default_rng(11)
    n, k = 2 * topk_search._STEP + 300, 5
    vectors = rng.integers(-64, 65, (n, 16))
    asks = list(range(0, n, 70))
    ids = [*asks, *range(n)]
    block = pa.table({
        "asks": [True] * len(asks) + [False] * n, "vec_id": pa.array(ids, pa.int64()), "row": pa.array(ids, pa.int64()),
        "vector": pa.array(vectors[ids].tolist(), pa.list_(pa.int64())),
    })
    found = topk_search._block_best(k, (4, 8))(block).to_pylist()
    scores = vectors @ vectors.T
    for q in asks:
        best = sorted(((-int(scores[q, j]), j) for j in range(n) if j != q))[:k]
        assert sorted((-r["score"], r["vec_id"]) for r in found if r["query_row"] == q) == best
