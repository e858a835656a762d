"""Records of delimited files whose quoted fields hold line breaks, read by many tasks a file.

Whether a line begins inside a quoted field depends on all lines before it. But a line maps each
of the two possible beginnings to an ending, and such maps can be joined: one pass joins
those of each file split, which is a row a split; joined over the splits of a file they say how
each split begins. A second pass then cuts every split into records by itself. Records that
reach over the end of a split come in parts, one a split, which are put together by their place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits, some 200 bytes each, that are broadcast with their beginnings.
_MAX_BROADCAST = 200_000
_WHERE = "_file string, _start bigint"


class Quotes:
    """How a line changes the state of a reader: outside or inside a quoted field.

    A field is quoted if it begins with the quote; a doubled quote in it is a quote, and what
    follows its end up to the separator belongs to it. A quote elsewhere is a character.
    """

    def __init__(self, sep: str = "\t", quote: str = '"'):
        s, q = re.escape(sep), re.escape(quote)
        inside = f"(?:[^{q}]|{q}{q})*+"
        field = f"(?:{q}{inside}{q}[^{s}]*+|(?!{q})[^{s}]*+)"
        self.quote = quote
        self._opens = re.compile(f"(?:{field}{s})*+{q}{inside}", re.DOTALL)
        self._closes = re.compile(f"{inside}{q}(?!{q})[^{s}]*+", re.DOTALL)
        self._sep = sep

    def ends_inside(self, line: str, inside: bool) -> bool:
        if self.quote not in line:
            return inside
        if inside:
            closed = self._closes.match(line)
            if closed is None:
                return True
            rest = line[closed.end() :]
            return bool(rest) and self.ends_inside(rest[len(self._sep) :], False)
        return self._opens.fullmatch(line) is not None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple[int, str]]]]:
    """The lines of a batch by split: a split's lines are read one after the other."""
    for batch in batches:
        held: list[tuple[int, str]] = []
        last = None
        for file, start, seq, value in zip(*(batch[c].to_pylist() for c in ("_file", "_start", "_seq", "value"))):
            if last is not None and last != (file, start):
                yield last, held
                held = []
            last = (file, start)
            held.append((seq, value))
        if held:
            yield last, held


def _maps(sep: str, quote: str, skip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, found = Quotes(sep, quote), {}
        for where, lines in _splits(batches):
            ends, n = found.get(where, ((False, True), 0))
            for _, line in lines:
                if where[1] or n >= skip:
                    ends = tuple(quotes.ends_inside(line, e) for e in ends)
                n += 1
            found[where] = (ends, n)
        rows = [(*where, *ends) for where, (ends, _) in found.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["_file", "_start", "from_outside", "from_inside"])

    return run


def _beginnings(lines: DataFrame, sep: str, quote: str, skip: int) -> DataFrame:
    """(_file, _start, _inside): how each split begins. A state is the last one that a split
    fixes, turned round by every split since that turns it round."""
    maps = lines.mapInArrow(_maps(sep, quote, skip), f"{_WHERE}, from_outside boolean, from_inside boolean")
    in_file = Window.partitionBy("_file").orderBy("_start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = maps.withColumns({"_fixed": fixed, "_turns": F.sum(turns).over(in_file)})
    last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_turns")), ignorenulls=True).over(earlier)
    before = F.coalesce(F.lag("_turns").over(in_file), F.lit(0))
    known = counted.withColumns({"_last": last, "_before": before})
    odd = (F.col("_before") - F.coalesce(F.col("_last._turns"), F.lit(0))) % 2 == 1
    state = F.coalesce(F.col("_last._fixed"), F.lit(False))
    return known.select("_file", "_start", (state != odd).alias("_inside"))


def _records(sep: str, quote: str, skip: int):
    """Whole records of a split, and the parts at its ends: the record that it begins in the
    middle of is part `head`, the one that it does not end is part `tail`, and if it is the same
    one, `through`. `_nth` counts the records that begin in the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(sep, quote)
        where, inside, n, nth, parts, broken = None, False, 0, 0, [], False
        rows: list[tuple] = []

        def close(kind: str) -> None:
            nonlocal parts, nth
            value = "\n".join(parts)
            if value or (parts and kind != "whole"):
                rows.append((*where, nth, kind, value))
                nth += kind in ("whole", "tail")
            parts = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["_file", "_start", "_nth", "kind", "value"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("_file", "_start", "value", "_inside")]
            for file, start, line, begins_inside in zip(*columns):
                if (file, start) != where:
                    close("through" if broken else "tail")
                    where, inside, n, nth, broken = (file, start), begins_inside, 0, 0, begins_inside
                n += 1
                if not start and n <= skip:
                    continue
                parts.append(line)
                inside = quotes.ends_inside(line, inside)
                if not inside:
                    close("head" if broken else "whole")
                    broken = False
                if len(rows) >= 2000:
                    yield flush()
        if where is not None:
            close("through" if broken else "tail")
        yield flush()

    return run


def quoted_records(
    spark: SparkSession, path: str, sep: str = "\t", quote: str = '"', skip: int = 0
) -> DataFrame:
    """(value, _file, _start, _nth): every record of delimited files, line breaks in quoted fields
    included, with the split that it begins in and its number, from 0, among those that do.

    The first `skip` lines of a file are no records, whatever they hold. Line ends are `\\n` or
    `\\r\\n`; within a record they become `\\n`. A record that a file's end leaves open ends there.
    Empty lines outside quotes are no records. A task holds one record; a record may reach
    over any number of splits.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    begins = _beginnings(lines, sep, quote, skip)
    splits = scan.rdd.getNumPartitions() + len(scan.inputFiles())
    if splits <= _MAX_BROADCAST:  # keeps the lines in their order
        placed = lines.join(F.broadcast(begins), ["_file", "_start"])
    else:
        placed = lines.join(begins, ["_file", "_start"]).repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_seq")
    schema = f"{_WHERE}, _nth bigint, kind string, value string"
    cut = placed.select("_file", "_start", "value", "_inside").mapInArrow(_records(sep, quote, skip), schema)
    whole = cut.where("kind = 'whole'").select("value", "_file", "_start", "_nth")
    # A tail begins a record; the parts up to the next tail belong to it. Two rows a split.
    ends = cut.where("kind <> 'whole'")
    in_file = Window.partitionBy("_file").orderBy("_start", F.col("kind") == "tail")
    numbered = ends.withColumn("_record", F.sum((F.col("kind") == "tail").cast("int")).over(in_file))
    joined = numbered.groupBy("_file", "_record").agg(
        F.sort_array(F.collect_list(F.struct("_start", "_nth", "value"))).alias("parts")
    )
    put_together = joined.select(
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"),
        "_file",
        F.col("parts")[0]["_start"].alias("_start"),
        F.col("parts")[0]["_nth"].alias("_nth"),
    )
    return whole.unionByName(put_together)


def numbered_records(records: DataFrame, row: str = "row_id") -> DataFrame:
    """(row, value) of ``quoted_records``, numbered from 0 by file name, then by place.

    Records are counted per split and joined back to one row a split.
    """
    splits = records.groupBy("_file", "_start").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return records.join(offsets, ["_file", "_start"]).select((F.col("_before") + F.col("_nth")).alias(row), "value")
