"""Mixing sources to target weights by a splitting tree of block quotas.

A source's documents are dealt into blocks by a hash. Its target gives an exact quota of
block draws: whole passes over all its blocks, and one partial pass in a permuted order
that ends inside a block. A binary tree over the output shards splits the quotas of all
sources with multivariate hypergeometric draws; each shard walks down from the root alone,
with generators seeded by the tree's nodes, and so learns its own counts and where its
draws begin. Draws are numbered in permuted order, so shards get disjoint blocks, and rows
are shuffled within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import store, uniform, word_count

#: The mixture is a setting with a weight for each source, read by the driver; more is an error.
MAX_SOURCES = 100_000
BLOCK_DOCS = 256
SHARD_WORDS = 4_000_000
_ORDER_BUCKET = 4096


def source_targets(
    sizes: Sequence[int], weights: Sequence[float], most: float = 3.0
) -> list[float]:
    """Share the total of the sizes by weight; a target stops at `most` times its size."""
    targets, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = most * float(sizes[i])
        left -= sum(targets[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return targets


def shard_quota(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by source of one shard, and of all shards before it."""
    low, high, counts = 0, shards, quotas.astype(np.int64)
    before = np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        total = int(counts.sum())
        share = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left, rest, pool = np.zeros_like(counts), share, total
        for i, n in enumerate(counts):  # one source after the other, given what is left
            pool -= int(n)
            left[i] = rng.hypergeometric(int(n), pool, rest) if rest and n else 0
            rest -= int(left[i])
        if shard < middle:
            high, counts = middle, left
        else:
            low, before, counts = middle, before + left, counts - left
    return counts, before


def _walk(quotas: list[int], shards: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts, before = shard_quota(np.array(quotas), shards, int(shard), seed)
                got = np.flatnonzero(counts)
                yield pd.DataFrame({"s": got, "shard": shard, "n": counts[got], "before": before[got]})

    return run


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Of one block, in key order, what still fits the need; then swaps that come nearer."""
    block = block.sort_values("mix_key")
    words, left = block["w"].to_numpy(float), float(block["need"].iloc[0])
    taken = np.zeros(len(words), bool)
    for i, w in enumerate(words):
        if w <= left:
            taken[i] = True
            left -= w
    for _ in range(8):
        out = np.append(np.flatnonzero(taken), -1)
        gain = words[~taken][None, :] - np.append(words[taken], 0.0)[:, None]
        if not gain.size or np.abs(left - gain).min() >= abs(left):
            break
        i, j = np.unravel_index(np.abs(left - gain).argmin(), gain.shape)
        left -= gain[i, j]
        taken[np.flatnonzero(~taken)[j]] = True
        if out[i] >= 0:
            taken[out[i]] = False
    return pd.DataFrame({"s": block["s"].iloc[:1], "chosen": [block["mix_key"].to_numpy()[taken]]})


def _numbered(blocks: DataFrame, seed: int) -> DataFrame:
    """Each block's place and the words before it in its pass's permuted order.

    Prefix sums run inside ranges of the order that hold a few thousand blocks each, plus
    totals of the ranges before, so that a source with very many blocks is not one task.
    """
    ordered = blocks.withColumn("order", uniform(F.lit(seed), F.col("pass"), F.col("s"), F.col("block")))
    ordered = ordered.withColumn("range", F.floor(F.col("order") * F.ceil(F.col("blocks") / _ORDER_BUCKET)))
    inside = Window.partitionBy("s", "pass", "range").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("s", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ordered.groupBy("s", "pass", "range")
        .agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("c"))
        .select("s", "pass", "range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    )
    return (
        ordered.withColumns({
            "w1": F.coalesce(F.sum("words").over(inside), F.lit(0)),
            "c1": F.count(F.lit(1)).over(inside),
        })
        .join(totals, ["s", "pass", "range"])
        .withColumns({"words_before": F.col("w0") + F.col("w1"), "rank": F.col("c0") + F.col("c1")})
        .drop("w0", "w1", "c0", "c1", "range", "order")
    )


def with_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """Adds `mix_size` (words), `mix_source` and `mix_key`, a repeatable number in [0, 1)."""
    return docs.withColumns({
        "mix_size": word_count(F.col(text_col)),
        "mix_source": F.col(source_col),
        "mix_key": uniform(F.lit(seed), F.col(id_col), F.col(text_col)),
    })


def mix_sources(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """Every row of `with_size`'s result with `source_size`, `target` and `draws`.

    Sources in code-point order, null last, get the weights in turn, repeating; the mix has
    as many words as the input. `draws` is an array of (pass, shard), one for each time the
    row is taken, at most ceil(`most`); empty when it is not. Words taken from a source come
    within half a document of its target, unless rows with one key (copies of id and text)
    are larger than that, which are taken or left together.

    Null ids and texts are rows like others (size 0); empty texts go with their block; a null
    source is a source. An empty table gives an empty result. Texts of any length are drawn
    whole, by their size. Other columns pass through, whatever their names; columns named
    like the added ones are replaced.
    """
    added = ("source_size", "target", "draws")
    row = F.struct(*[F.col(f"`{c}`") for c in sized.columns if c not in added]).alias("mix_row")
    rows = sized.select(row, "mix_size", "mix_source", "mix_key")
    rows = rows.withColumn("s_name", F.struct(F.col("mix_source").isNull().alias("none"), F.coalesce("mix_source", F.lit("")).alias("name")))
    found = (
        rows.groupBy("s_name").agg(F.sum("mix_size").alias("size"), F.count(F.lit(1)).alias("docs"))
        .orderBy("s_name").limit(MAX_SOURCES + 1).collect()
    )
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = sized.sparkSession
    sizes = [r["size"] for r in found]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    plan = []
    for i, (r, target) in enumerate(zip(found, targets)):
        blocks = max(1, -(-r["docs"] // BLOCK_DOCS))
        passes = int(target // r["size"]) if r["size"] else 0
        plan.append((r["s_name"], i, r["size"], target, blocks, passes, target - passes * r["size"]))
    sources = store(
        spark.createDataFrame(plan, "s_name struct<none:boolean,name:string>, s int, source_size long, target double, blocks long, passes int, rest double"),
        "mix-sources",
    )
    rows = rows.join(sources, "s_name").withColumn("block", F.floor(F.col("mix_key") * F.col("blocks")))
    blocks = rows.groupBy("s", "block").agg(F.sum("mix_size").alias("words"))
    numbered = _numbered(
        blocks.join(sources.select("s", "blocks", "passes", "rest"), "s")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))),
        seed,
    )
    drawn = store(
        numbered.where((F.col("pass") < F.col("passes")) | (F.col("words_before") < F.col("rest"))).select(
            "s", "block", "pass",
            # blocks without a document have no row, so places run over those that have
            "rank",
            F.when((F.col("pass") == F.col("passes")) & (F.col("words_before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("words_before")).alias("need"),
        ),
        "mix-draws",
    )
    # Where the partial pass ends inside a block: the keys of its documents that are taken.
    ends = drawn.where("need IS NOT NULL")
    cuts = (
        rows.join(ends.select("s", "block", "need"), ["s", "block"])
        .groupBy("s", "need", "mix_key").agg(F.sum("mix_size").alias("w"))
        .groupBy("s").applyInPandas(_fill, "s int, chosen array<double>")
    )
    per_source = drawn.groupBy("s", "pass").count().groupBy("s").agg(
        F.sum("count").alias("quota"), F.map_from_entries(F.collect_list(F.struct("pass", "count"))).alias("by_pass")
    )
    quota = {r["s"]: r["quota"] for r in per_source.select("s", "quota").collect()}
    quotas = [quota.get(i, 0) for i in range(len(found))]
    shards = max(1, round(sum(sizes) / SHARD_WORDS))
    leaves = spark.range(shards).mapInPandas(_walk(quotas, shards, seed), "s int, shard long, n long, before long")
    seats = leaves.select("s", "shard", F.posexplode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("i", "number")).drop("i")
    earlier = F.coalesce(F.expr("aggregate(map_values(map_filter(by_pass, (p, n) -> p < pass)), 0L, (a, x) -> a + x)"), F.lit(0))
    placed = (
        drawn.join(per_source.select("s", "by_pass"), "s")
        .withColumn("number", F.col("rank") + earlier)
        .join(seats, ["s", "number"])
        .join(cuts, "s", "left")
        .groupBy("s", "block")
        .agg(F.collect_list(F.struct("pass", "shard", F.when(F.col("need").isNotNull(), F.coalesce("chosen", F.array().cast("array<double>"))).alias("chosen"))).alias("planned"))
    )
    placed = store(placed, "mix-plan")
    return (
        rows.join(placed, ["s", "block"], "left")
        .withColumn("draws", F.coalesce(
            F.expr("transform(filter(array_sort(planned), d -> d.chosen IS NULL OR array_contains(d.chosen, mix_key)), d -> struct(d.pass AS pass, d.shard AS shard))"),
            F.array().cast("array<struct<pass:int,shard:bigint>>"),
        ))
        .select("mix_row.*", *added)
    )


def shuffled_shards(mixed: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """One row per draw with `shard`, rows of a shard together and in a repeatable random order.

    `shards` is the number of tasks; a shard is never split between two. The column `draws`
    goes; a column `shard` is replaced, others pass through whatever their names. Rows without
    draws, and an empty table, give no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("draws", "shard")]).alias("mix_row")
    drawn = mixed.select(row, "mix_key", F.explode("draws").alias("draw")).withColumns({
        "shard": F.col("draw.shard"),
        "place": F.xxhash64(F.lit(seed), "draw.pass", "draw.shard", "mix_key"),
    })
    dealt = drawn.repartition(shards, "shard") if shards else drawn.repartition("shard")
    return dealt.sortWithinPartitions("shard", "place").select("mix_row.*", "shard")
