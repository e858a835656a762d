"""N-gram Jaccard join: subsets for small sets, inverted lists for large ones.

Two sets of sizes n and m link when 100 * overlap >= 80 * union, so when their overlap
reaches c(n, m) = ceil(4 (n + m) / 9). A small set is listed under each of its subsets of
the sizes c that a partner may ask for: sets that link share a whole subset. A large set is
listed under its rarest shingles, as many as a partner cannot all miss (a fifth and one
more). The boundary is where a set's subsets cost more than its lists would. Sets at the
boundary are listed both ways, so every pair has a list in common.

What is rare is learned from a bounded sample of sets: any fixed order of shingles gives
the same links, so the sample decides on cost alone. Sets of one list are not paired with
each other at once: each is compared with the list's pivot, and what is linked already is
not compared again; only lists that then still hold several components go on, at the end
with every pair between components. Exact copies are folded into one set before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.batches import text_slices
from textlens.llm.common import store, uniform
from textlens.llm.components import connected_components
from textlens.llm.shingles import fingerprints, fold, mix, parities, shingle_sets

#: Sets from which the frequent shingles are learned, and how many of these are kept.
SAMPLE_SETS, FREQUENT = 100_000, 1_000_000
#: Shingles that a task counts at a time before they are shuffled, and shuffled counts that a task adds up.
COUNTED, ADDED = 1 << 18, 250_000
#: What one entry of an inverted list costs, in subsets.
LIST_COST = 16
#: Pairs up to this number are sent to the texts, 24 bytes each; beyond, Spark joins as it sees fit.
SENT_PAIRS = 2_000_000


def overlap_needed(n: int, m: int) -> int:
    return -(-4 * (n + m) // 9)


def listed(n: int) -> int:
    """How many of its first shingles a large set is listed under."""
    return n - ceil(0.8 * n - 1e-9) + 1


def subset_sizes(n: int) -> list[int]:
    """The overlaps that partners of any size may need."""
    return sorted({overlap_needed(n, m) for m in range(-(-4 * n // 5), 5 * n // 4 + 1)})


def boundary(list_cost: float = LIST_COST, most: int = 64) -> int:
    """The largest size up to which enumerating subsets is the cheaper way."""
    n = 1
    while n < most and sum(comb(n + 1, c) for c in subset_sizes(n + 1)) <= list_cost * listed(n + 1):
        n += 1
    return n


def list_keys(shingles: np.ndarray, rare_first: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set, and how many of its shingles come before each in the order of the
    lists, `rare_first`; none before a subset."""
    n = len(shingles)
    parts, places = [shingles[:0]], [np.zeros(0, np.int32)]
    if n <= small:
        for c in subset_sizes(n):
            if c <= n:
                rows = shingles[np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)]
                parts.append(mix(mix(rows).sum(axis=1, dtype=np.uint64) + np.uint64(c)))
                places.append(np.zeros(len(rows), np.int32))
    if n > small or 5 * n >= 4 * (small + 1):
        parts.append(mix(rare_first[: listed(n)] ^ np.uint64(0xD6E8FEB86659FD93)))
        places.append(np.arange(listed(n), dtype=np.int32))
    return np.concatenate(parts), np.concatenate(places)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return shingle_sets(batch["text"].to_pylist())


_BITS = ("p0", "p1", "p2", "p3")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = list(_sets(batch))
        odd = [parities(x) for x in sets]
        marks = [(len(x), *fingerprints(x), *fold(o, 32).view(np.int64)) for x, o in zip(sets, odd)]
        marks = np.array(marks, np.int64).reshape(-1, 7)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *[pa.array(marks[:, i].copy()) for i in range(7)], pa.array([o.tobytes() for o in odd], pa.binary())],
            ["doc_id", "n", "one", "two", *_BITS, "odd"],
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        shingles, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(times.astype(np.int64))], ["shingle", "times"])

    held, size = [], 0
    for batch in text_slices(batches):
        sets = list(_sets(batch))
        held += sets
        size += sum(map(len, sets))
        if size >= COUNTED:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def shingle_counts(texts: DataFrame, expected: int) -> DataFrame:
    """`shingle, count` over the sets of `text`; `expected` is about the sum of their sizes.

    Few shingles repeat, so a task that counted all of its own would hold nearly all: it counts
    some at a time, and what is shuffled is added up in as many parts as keep each small.
    """
    counted = texts.select("text").mapInArrow(_counted, "shingle long, times long")
    return counted.repartition(1 + expected // ADDED, "shingle").groupBy("shingle").agg(F.sum("times").alias("count"))


def _entries(frequent, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = frequent.value
        seen: set[tuple[int, int]] = set()  # copies in one task are listed once
        for batch in text_slices(batches):
            keys, places, ones, sizes = [], [], [], []
            for x in _sets(batch):
                mark = fingerprints(x)
                if not len(x) or mark in seen:
                    continue
                seen.add(mark)
                rank = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, order[at], 0)
                mine, before = list_keys(x, x[np.lexsort((x, rank))], small)
                keys.append(mine.view(np.int64))
                places.append(before)
                ones.append(np.full(len(mine), mark[0]))
                sizes.append(np.full(len(mine), len(x)))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), pa.array(np.concatenate(ones)), pa.array(np.concatenate(sizes).astype(np.int32))],
                    ["key", "place", "one", "n"],
                )

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the set in the place of the text, and drops rows that are not the set asked for."""
    for batch in text_slices(batches):
        sets = list(_sets(batch))
        right = [i for i, (x, one) in enumerate(zip(sets, batch["one"].to_pylist())) if fingerprints(x)[0] == one]
        kept = batch.take(pa.array(right, pa.int64()))
        columns = [kept.column(n) for n in kept.schema.names if n not in ("text", "one")]
        names = [n for n in kept.schema.names if n not in ("text", "one")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].tobytes() for i in right], pa.binary())], [*names, "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch["left"], batch["right"]):
            a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            keep.append(100 * both >= 80 * (len(a) + len(b) - both))
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["pivot"].filter(kept), batch["member"].filter(kept)], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more bits than their sets may in shingles."""
    for batch in batches:
        keep = []
        sides = (batch["n"].to_pylist(), batch["m"].to_pylist(), batch["left"], batch["right"])
        for n, m, left, right in zip(*sides):
            a, b = np.frombuffer(left.as_buffer(), np.uint8), np.frombuffer(right.as_buffer(), np.uint8)
            size = min(len(a), len(b))
            bits = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
            keep.append(bits <= n + m - 2 * overlap_needed(n, m))
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["pivot"].filter(kept), batch["member"].filter(kept)], ["pivot", "member"])


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that full-size parities do not rule out; they are some 60 times smaller than sets."""
    left = classes.select(F.col("node").alias("pivot"), "n", F.col("odd").alias("left"))
    right = classes.select(F.col("node").alias("member"), F.col("n").alias("m"), F.col("odd").alias("right"))
    return pairs.join(left, "pivot").join(right, "member").mapInArrow(_near, "pivot long, member long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sets link, from the texts of the classes' documents.

    The member's set travels to the pivot, so a text is read once for all its pairs.
    """
    size = pairs.count()
    few = F.broadcast if size <= SENT_PAIRS else (lambda df: df)
    members = pairs.groupBy("member").agg(F.collect_list("pivot").alias("pivots"))
    members = store(members.join(classes.select(F.col("node").alias("member"), "one"), "member"), "members")
    pivots = store(pairs.select("pivot").distinct().join(classes.select(F.col("node").alias("pivot"), "one"), "pivot"), "pivots")
    left = docs.join(few(members), docs["doc_id"] == members["member"]).select("member", "pivots", "one", "text")
    left = left.mapInArrow(_with_sets, "member long, pivots array<long>, shingles binary")
    left = left.select("member", F.explode("pivots").alias("pivot"), F.col("shingles").alias("left"))
    right = docs.join(few(pivots), docs["doc_id"] == pivots["pivot"]).select("pivot", "one", "text")
    right = right.mapInArrow(_with_sets, "pivot long, shingles binary").select("pivot", F.col("shingles").alias("right")).dropDuplicates(["pivot", "right"])
    joined = left.join(right, "pivot")
    return store(joined.select("pivot", "member", "left", "right").mapInArrow(_linked, "a long, b long"), "links")


def _fits() -> Column:
    """Whether two members of a list can link if the list is the first they share: what either
    has before it the other lacks, and together they may lack n + m - 2 c(n, m). Nor may
    their parities differ in more bits."""
    n, m = F.col("n"), F.col("pivot_n")
    room = n + m - 2 * F.ceil(4 * (n + m) / 9 - 1e-9)
    bits = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"pivot_{p}"))) for p in _BITS), F.lit(0))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (F.col("place") + F.col("pivot_place") <= room) & (bits <= room)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 2, list_cost: float = LIST_COST) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row.

    `component_id` is the smallest id that links reach. A null or empty text, or one without
    words, has no shingles and links with nothing; a null id links with nothing and has a
    null component. Rows that repeat an id with one text are one document; with several
    texts they connect what these link to. Other columns are not read; an empty table gives
    an empty result.

    Memory of a task: the texts of a batch, and a fingerprint of each text of the task. Only
    the frequent shingles of the sample are sent to all tasks: at most a million, 16 bytes each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shapes = store(texts.mapInArrow(_shapes, "doc_id long, n long, one long, two long, p0 long, p1 long, p2 long, p3 long, odd binary"), "shapes")
    classes = store(
        shapes.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "one", "two").agg(F.min("doc_id").alias("node"), *[F.first(p).alias(p) for p in (*_BITS, "odd")]), "classes"
    )
    sets, shingles = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = SAMPLE_SETS / max(1, sets)
    sample = classes.select("node").where(uniform(F.lit("order"), "node") < share)
    sampled = texts.join(F.broadcast(store(sample.limit(2 * SAMPLE_SETS), "sample")), F.col("doc_id") == F.col("node"))
    common = (
        shingle_counts(sampled, int(shingles * min(1.0, share)))
        .where("count > 2").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    )
    known, seen = common["shingle"].to_numpy().view(np.uint64), common["count"].to_numpy()
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], seen[order]))

    entries = texts.where("doc_id IS NOT NULL").select("text").mapInArrow(_entries(frequent, boundary(list_cost)), "key long, place int, one long, n int")
    by_key = Window.partitionBy("key")
    lists = store(
        entries.withColumns({"low": F.min("one").over(by_key), "high": F.max("one").over(by_key)})
        .where("low < high").groupBy("key", "one", "n").agg(F.min("place").alias("place"))
        .join(classes.select("one", "node", F.col("n").alias("size"), *_BITS), "one").where("n = size")
        .select("key", "node", "n", "place", *_BITS),
        "lists",
    )
    frequent.destroy()  # the lists are stored, nothing reads it again
    links = None
    tried = None
    component = None
    step = 0
    while step <= star_rounds:
        rows = lists
        if component is not None:
            rows = rows.join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
            several = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
            rows = store(rows.join(several, "key"), "open-lists")
            if rows.isEmpty():
                break
        else:
            rows = rows.withColumn("c", F.col("node"))
        if step < star_rounds:
            # first the member with the fewest shingles of its own, then any
            first = F.xxhash64(F.lit(step), "node") if step else F.col("place").cast("long")
            best = F.struct(first.alias("first"), F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("place").alias("pivot_place"), *[F.col(p).alias(f"pivot_{p}") for p in _BITS], F.col("c").alias("pivot_c"))
            pivots = rows.groupBy("key").agg(F.min(best).alias("best")).select("key", "best.*")
            pairs = rows.join(pivots, "key").where((F.col("c") != F.col("pivot_c")) & _fits())
        else:
            others = rows.select("key", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("place").alias("pivot_place"), *[F.col(p).alias(f"pivot_{p}") for p in _BITS], F.col("c").alias("pivot_c"))
            pairs = rows.join(others, "key").where((F.col("c") != F.col("pivot_c")) & (F.col("pivot") < F.col("node")) & _fits())
        pairs = pairs.select(
            F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("member")
        ).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["pivot", "member"], "left_anti")
        pairs = store(_possible(pairs, classes), "pairs")
        if component is not None and pairs.isEmpty():
            # a round of pivots says nothing of the other members: only the last round may end it
            step = star_rounds if step < star_rounds else star_rounds + 1
            continue
        found = _verified(texts, pairs, classes)
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        component = connected_components(links)
        step += 1
    resolved = classes.join(component, "node", "left").select("n", "one", "two", F.coalesce("component", "node").alias("c"))
    labelled = store(
        shapes.join(resolved, ["n", "one", "two"], "left")
        .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("c")),
        "labelled",
    )
    # Ids with several texts join the components of these.
    bridges = labelled.where("c IS NOT NULL").groupBy("doc_id").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high OR low > doc_id")
    if not bridges.isEmpty():
        more = bridges.select(F.col("low").alias("a"), F.col("doc_id").alias("b")).union(labelled.join(bridges.select("doc_id"), "doc_id").select("doc_id", "c"))
        final = connected_components(more.union(labelled.where("c IS NOT NULL").select("doc_id", "c")))
        labelled = labelled.join(final, labelled["doc_id"] == final["node"], "left").select("doc_id", "n", F.coalesce("component", "c").alias("c"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
