"""Arrays of spans in one text, with DataFrame functions whose time grows with text and spans.

A fold that appends to an array copies it each time, and a substring counts from the beginning
of the text. So folds run in blocks, whose results are joined, and texts are cut in chunks first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold appends to one array, and code points of a chunk.
BLOCK, CHUNK = 256, 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once for each row, also if used inside lambdas."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of an array of ints, what `merge` makes of `zero` and those before it."""
    empty = F.array().cast("array<int>")

    def scan(items: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(zero).alias("t"), empty.alias("o"))
        return F.aggregate(
            items, start, lambda a, x: F.struct(merge(a["t"], of(x)).alias("t"), F.array_append(a["o"], a["t"]).alias("o"))
        )

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: scan(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x))

    def joined(parts: Column) -> Column:
        before = scan(parts, lambda p: p["t"])["o"]
        return F.flatten(F.zip_with(parts, before, lambda p, s: F.transform(p["o"], lambda x: merge(s, x))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(empty))


def chunks(text: Column) -> Column:
    """The text in pieces of `CHUNK` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points from `start` to before `end` of a text in chunks.

    No part is a literal: the optimizer would push `lower` onto it and compute that in the driver, where
    the first use of `lower` makes Spark's table of letter cases of all code points.
    """

    def part(k: Column) -> Column:
        skip = F.greatest(start - k * CHUNK, F.lit(0))
        return F.substring(F.get(cut, k), skip + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - skip)

    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    chosen = F.when(end > start, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(chosen, part), "")


def match_starts(gaps: Column, matches: Column) -> Column:
    """Where each match begins, from the matches of a pattern and the gaps around them."""

    def places(g: Column) -> Column:
        steps = F.zip_with(g, matches, lambda a, b: F.length(a) + F.length(b))
        return F.zip_with(running(steps, lambda a, b: a + b, 0), g, lambda at, gap: at + F.length(gap))

    return let(F.slice(gaps, F.lit(1), F.size(matches)), places)


_FAR = (1 << 31) - 1


def clear_of(spans: Column, others: Column) -> Column:
    """The `(kind, start, end)` of those spans that overlap none of the others, by start.

    All are swept in order of start, forwards with the furthest end of the others so far and
    backwards with their nearest start.
    """

    def row(mine: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), s["kind"].alias("kind"))

    def swept(both: Column) -> Column:
        ends = F.transform(both, lambda s: F.when(s["mine"] == 0, s["end"]).otherwise(0))
        starts = F.transform(both, lambda s: F.when(s["mine"] == 0, s["start"]).otherwise(_FAR))
        furthest = running(ends, F.greatest, 0)
        nearest = F.reverse(running(F.reverse(starts), F.least, _FAR))
        bounds = F.zip_with(furthest, nearest, lambda a, b: F.struct(a.alias("furthest"), b.alias("nearest")))
        with_bounds = F.zip_with(both, bounds, lambda s, b: F.struct(s.alias("s"), b.alias("b")))
        kept = F.filter(
            with_bounds,
            lambda x: (x["s"]["mine"] == 1) & (x["b"]["furthest"] <= x["s"]["start"]) & (x["b"]["nearest"] >= x["s"]["end"]),
        )
        return F.transform(
            kept, lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"))
        )

    return let(F.array_sort(F.concat(F.transform(others, row(0)), F.transform(spans, row(1)))), swept)
