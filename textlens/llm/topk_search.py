"""Exact top-k by inner product, pruned by segment means and deviations.

Each vector is summarised by the mean and deviation of its segments. For one segment of
length l, `sum q_i x_i <= l (mq mx + sq sx)`, which is the classical lower bound on the
distance written for the inner product. A task takes one block of queries and one block
of candidates, keeps the k best scores of each query so far, bounds the next candidates
from coarse to fine segments and computes exact scores only where no level rules a pair
out. Ties at the k-th score are never ruled out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import store
from textlens.llm.vector_neardup import finite_vector

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
MAX_TASKS = 100_000
_STEP = 1024
_BEST = "query_row long, query_id long, vec_id long, score long"


def segment_bounds(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that a product of two is the bound."""
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:]):
        piece = vectors[:, a:b]
        parts += [piece.mean(axis=1) * np.sqrt(b - a), piece.std(axis=1) * np.sqrt(b - a)]
    return np.stack(parts, axis=1)


def _keep_best(best: tuple, q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    q = np.concatenate([best[0], q])
    score = np.concatenate([best[1], score])
    ids = np.concatenate([best[2], ids])
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.searchsorted(q, q, side="left")
    kept = np.arange(len(q)) - first < k
    return q[kept], score[kept], ids[kept]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _block_best(k: int, levels: tuple[int, ...]):
    def run(block: pa.Table) -> pa.Table:
        queries, candidates = block.filter(block["asks"]), block.filter(pc.invert(block["asks"]))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        asked = best[:2]
        if queries.num_rows and candidates.num_rows:
            q, x = _matrix(queries), _matrix(candidates)
            qid, xid = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
            own, rows = queries["row"].to_numpy(), candidates["row"].to_numpy()
            limit = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
            if limit < 2**53:  # sums are exact in doubles
                q, x = q.astype(np.float64), x.astype(np.float64)
            bounds = [(segment_bounds(q.astype(np.float64), n), segment_bounds(x.astype(np.float64), n)) for n in levels]
            slack = 1e-9 * (1.0 + limit)
            floor = np.full(len(qid), -np.inf)
            for s in range(0, len(xid), _STEP):
                part = slice(s, s + _STEP)
                alive = own[:, None] != rows[None, part]
                if s:
                    for bq, bx in bounds:
                        alive &= (bq @ bx[part].T) + slack >= floor[:, None]
                i, j = np.nonzero(alive)
                j += s
                if len(i) > alive.size // 32:  # dense survivors: one product is cheaper than pairs
                    score = (q @ x[part].T)[i, j - s].astype(np.int64)
                    i_left = 0
                else:
                    score, i_left = np.empty(len(i), np.int64), len(i)
                for c in range(0, i_left, 1 << 17):
                    at = slice(c, c + (1 << 17))
                    score[at] = np.einsum("ij,ij->i", q[i[at]], x[j[at]]).astype(np.int64)
                good = score >= floor[i]
                best = _keep_best(best, i[good], score[good], xid[j[good]], k)
                found, counts = np.unique(best[0], return_counts=True)
                last = np.cumsum(counts) - 1
                full = counts >= k
                floor[found[full]] = best[1][last[full]]
            asked = (own[best[0]], qid[best[0]])
        return pa.table(
            {
                "query_row": pa.array(asked[0], pa.int64()),
                "query_id": pa.array(asked[1], pa.int64()),
                "vec_id": pa.array(best[2], pa.int64()),
                "score": pa.array(best[1], pa.int64()),
            }
        )

    return run


def _dealt(rows: DataFrame, blocks: DataFrame, own: str, other: str) -> DataFrame:
    return (
        rows.join(blocks, "width")
        .withColumn(own, F.pmod(F.xxhash64("row"), F.col(f"{own}s")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        .select("width", "qb", "cb", "row", "vec_id", "vector", F.lit(own == "qb").alias("asks"))
    )


def top_k_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    levels: tuple[int, ...] = (4, 16),
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k largest integer inner products of each query.

    Components become floor(scale * x). `is_query` is a condition on the id column.
    Candidates are all rows with a vector of the query's length but the query's own row; ties
    go to the smaller id. A query with fewer than k candidates gets them all, one with none
    has no row. Null or empty vectors, vectors with a null or non-finite member and rows
    with a null id take no part. Rows that repeat an id, or a whole row, are rows of their own:
    each is a candidate of the other, and each query row gets its own k results. Scores
    beyond 64 bits are undefined. Other columns are not read; an empty table gives no rows.

    Queries and candidates meet in blocks, so no task holds more than a block of either and
    returns at most k rows a query; a final per-query limit joins the blocks.
    """
    usable = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("raw")).where(
        F.col("vec_id").isNotNull() & finite_vector(F.col("raw"))
    )
    # Stored, so that a row has the same number as a query and as a candidate.
    rows = store(usable.withColumn("row", F.monotonically_increasing_id()), "search-rows").select(
        "row",
        "vec_id",
        F.transform("raw", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector"),
        F.size("raw").alias("width"),
    )
    queries = rows.where(is_query)
    blocks = store(rows.groupBy("width").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(candidate_block))).cast("int").alias("cbs"),
        F.greatest(
            F.lit(1), F.ceil(F.count(F.when(is_query, 1)) / F.lit(float(query_block))).cast("int")
        ).alias("qbs"),
    ), "search-blocks")
    pairs = blocks.agg(F.sum(F.col("qbs") * F.col("cbs"))).first()[0] or 1
    dealt = _dealt(queries, blocks, "qb", "cb").union(_dealt(rows, blocks, "cb", "qb"))
    # One task a pair of blocks: the bytes are few, the products many.
    dealt = dealt.repartition(min(pairs, MAX_TASKS), "width", "qb", "cb")
    best = dealt.groupBy("width", "qb", "cb").applyInArrow(_block_best(k, levels), _BEST)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
