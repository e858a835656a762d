"""Near-duplicate vectors: int8 tile products with error bounds, then full precision.

Vectors are compared within one label. Each label is cut into tiles by a hash of the
vector, and every pair of tiles is one task of bounded size. In a task the unit vectors
are quantised to int8; the product of the codes and a bound on the quantisation error of
either vector give a number that the true cosine cannot exceed. Only pairs for which it
reaches the threshold are computed again in double precision. A task returns link counts
and a spanning forest of its links, never the links, so a large group of near copies
stays linear in what is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import fingerprint, store
from textlens.llm.components import connected_components

TILE_ROWS = 2048
MAX_TASKS = 100_000
_LINKS = "node long, links long, root long"


def finite_vector(vector: Column) -> Column:
    """True for an array without null, NaN or infinite members; false for a null array."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False)) & (F.size(vector) > 0)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors, and norms of what the codes miss."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes.astype(np.float64) * scale[:, None]
    error = np.sqrt(((unit - coded) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return codes, scale, np.sqrt((coded**2).sum(axis=1)), error


def upper_bounds(a: tuple, b: tuple) -> np.ndarray:
    """What the cosine of each pair cannot exceed, from codes and error bounds."""
    wide = np.float32 if a[0].shape[1] <= 1000 else np.float64  # sums of int8 products stay exact
    product = (a[0].astype(wide) @ b[0].astype(wide).T).astype(np.float64)
    product *= a[1][:, None]
    product *= b[1][None, :]
    product += np.outer(a[3], b[2] + b[3])
    product += np.outer(a[2], b[3])
    return product + 1e-12


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _tile_links(threshold: float, rows_at_once: int = 512):
    def run(table: pa.Table) -> pa.Table:
        side = table["tile"].to_numpy()
        first, second = table["i"][0].as_py(), table["j"][0].as_py()
        node, members = table["node"].to_numpy(), table["members"].to_numpy()
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(len(node), -1)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in squares
        unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        left = np.flatnonzero(side == first)
        right = np.flatnonzero(side == second)
        q = quantise(unit)
        at, to = [], []
        for s in range(0, len(left), rows_at_once):
            part = left[s : s + rows_at_once]
            hit = upper_bounds([x[part] for x in q], [x[right] for x in q]) >= threshold
            i, j = np.nonzero(hit)
            i, j = part[i], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 16):
                x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                sure = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                at.append(x[sure])
                to.append(y[sure])
        i = np.concatenate(at) if at else np.zeros(0, np.int64)
        j = np.concatenate(to) if to else np.zeros(0, np.int64)
        links = np.bincount(i, members[j], len(node)) + np.bincount(j, members[i], len(node))
        kept = np.flatnonzero(links)
        root = node[_roots(len(node), i, j)]
        return pa.table(
            {
                "node": pa.array(node[kept], pa.int64()),
                "links": pa.array(links[kept].astype(np.int64), pa.int64()),
                "root": pa.array(root[kept], pa.int64()),
            }
        )

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Every input row with `n_links`, `component_id` and `kept`.

    Two vectors link when their labels are equal and not null, their lengths are equal and
    their cosine in double precision is at least `threshold`. `n_links` counts the other
    vectors linked directly, `component_id` is the smallest id that links reach, `kept` is
    true where both are the same. Equal vectors are folded into one before tiles are made
    and counted as its members.

    A null, empty or zero vector, or one with a null or non-finite member, links with
    nothing, as does a row with a null label or id; a null id has a null component and is
    not kept. Rows that repeat an id count as vectors of their own and share its component.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & finite_vector(F.col("vector"))
        & F.exists("vector", lambda x: x != 0)
    )
    one, two = fingerprint(F.col("vector"))
    rows = rows.withColumns({"one": F.when(usable, one), "two": two})
    key = ["label", "one", "two"]
    classes = store(
        rows.where("one IS NOT NULL")
        .groupBy(*key)
        .agg(
            F.min("vec_id").alias("node"),
            F.count(F.lit(1)).alias("members"),
            F.first("vector").alias("vector"),
        )
        .withColumn("width", F.size("vector")),
        "vector-classes",
    )
    tiles = store(
        classes.groupBy("label", "width").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(float(tile_rows))).cast("int").alias("tiles")
        ),
        "vector-tiles",
    )
    pairs = tiles.agg(F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2).cast("long")).first()[0] or 1
    dealt = (
        classes.join(tiles, ["label", "width"])
        .withColumn("tile", F.pmod(F.xxhash64("one", "two"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "label",
            "width",
            F.least("tile", "other").alias("i"),
            F.greatest("tile", "other").alias("j"),
            "tile",
            "node",
            "members",
            "vector",
        )
    )
    # One task a pair of tiles: the bytes are few, the products many.
    dealt = dealt.repartition(min(pairs, MAX_TASKS), "label", "width", "i", "j")
    found = store(
        dealt.groupBy("label", "width", "i", "j").applyInArrow(_tile_links(threshold), _LINKS),
        "vector-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "node", "root")
    resolved = (
        classes.select(*key, "node", "members")
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .select(
            *key,
            (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    return rows.join(resolved, key, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
