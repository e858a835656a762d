"""Best-fit packing planned on the histogram of lengths.

The plan never sees a document. It takes the counts of the lengths, at most as many numbers
as a sequence has tokens, from the longest down, and deals whole groups of equal sequences:
all pieces of a length go to the fullest sequences that still have room, as many to each as
fit. A group is met at most log2(size) times, because what is left of its room is less than
half each time, so the plan has some ten slots for each length, whatever the input.

Pieces then take the planned slots by their rank within their length. A task numbers its own
pieces of each length; sums of the counts of the tasks before it make that the rank, and the
rank picks the slot. No piece is sorted, and no length is brought to one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.batches import text_slices
from textlens.llm.common import store
from textlens.llm.token_ids import ByteLevelIds

SEQUENCE = 1024
END_ID = 2


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots `(length, low, high, sequence, each, offset)` for counts of lengths up to `size`.

    The pieces of a length with ranks from `low` to `high` - 1 go to the sequences from
    `sequence` on, `each` to a sequence, the first of them at `offset`.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room left: first sequence, count
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def deal(first: int, count: int, free: int) -> int:
            """Deals pieces to some of these equal sequences; returns how many of them it used."""
            nonlocal left, rank
            used, each = 0, free // length
            for times, load in ((min(count, left // each), each), (1, left % each)):
                if not times or not load or used + times > count or times * load > left:
                    continue
                slots.append((length, rank, rank + times * load, first + used, load, size - free))
                room[free - load * length].append((first + used, times))
                used, left, rank = used + times, left - times * load, rank + times * load
            return used

        for free in range(length, size):
            groups, room[free] = room[free], []
            for first, count in groups:
                used = deal(first, count, free) if left else 0
                if used < count:
                    room[free].append((first + used, count - used))
        if left:
            count = -(-left // (size // length))
            deal(sequences, count, size)
            sequences += count
    return slots


_PIECES = "piece int, start long, length int, ids_crc32 long, part int, place long"
_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = ByteLevelIds.of_worker(path), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names = [n.split(" ")[0] for n in _PIECES.split(", ")] + ["ids"] * with_ids
        for batch in text_slices(batches):
            rows, owner = [], []
            for k, ids in enumerate(encoder.encode([t or "" for t in batch["text"].to_pylist()])):
                ids += end
                total = len(ids) // 4
                cuts = range(total % size or size, total + 1, size)
                for piece, stop in enumerate(cuts):
                    start = max(0, stop - size)
                    own = ids[4 * start : 4 * stop] if piece else ids[: 4 * stop]
                    length = len(own) // 4
                    rows.append((piece, stop - length, length, zlib.crc32(own), part, seen[length], own))
                    owner.append(k)
                    seen[length] += 1
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES[: len(names)])]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(owner, pa.int64())), *columns], ["id", *names])

    return run


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: `<id_col>, piece, start, length, ids_crc32, sequence_id, offset`.

    `tokenizer` is the path of a byte-level vocabulary file, at the same place on every
    executor. The ids of a text are followed by `end_id`; only documents longer than `size`
    are cut, into pieces of `size` ids, of which the first may be shorter. Sequences are
    numbered from 0; a sequence has no gaps and at most `size` ids. `with_ids` adds the ids of
    the piece as little-endian 32-bit integers.

    A null or empty text is a document of one id. Null ids stay null; repeated rows, and rows
    that share an id, are packed each for itself. Documents of one length are interchangeable:
    which of them takes which slot follows from the partitions of the input. Texts of any
    length are encoded whole. Other columns are not read; an empty table gives no pieces.

    The pieces are a table in the shared folder, so that ranks are worked out from what was
    written once. The driver holds the histogram and the plan: `size` counts and some ten
    slots for each, the only thing that is broadcast, whatever the input.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_PIECES}" + ", ids binary" * with_ids
    pieces = store(rows.mapInArrow(_pieces(tokenizer, size, end_id, with_ids), schema), "pieces")
    counts = store(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = docs.sparkSession.createDataFrame(
        plan(histogram, size), "length int, low long, high long, sequence long, each long, at long"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("place"))
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(slots).withColumnRenamed("length", "slot_length"), (F.col("length") == F.col("slot_length")) & inside)
        .select(
            F.col("id").alias(id_col),
            "piece",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
            (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
