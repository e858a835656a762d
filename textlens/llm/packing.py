"""Packing documents into fixed-size sequences by the online sum-of-squares rule.

Each partition packs its own documents in one pass. An array counts the open sequences at
each fill level; a document goes to the level (or to a new sequence) after which the sum of
squared counts is smallest, which keeps levels evenly used and gaps rare. Documents longer
than a sequence are cut, and when the input ends the open sequences are closed by moving
pieces between them, cut where needed, so that a partition leaves at most one short one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.batches import text_slices
from textlens.llm.token_ids import WordEndIds

SEQUENCE = 4096
END_ID = 2


class SumOfSquares:
    """Open sequences by fill level. `place` takes (document, start, ids); closed ones come out."""

    def __init__(self, size: int = SEQUENCE):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def level_for(self, length: int) -> int:
        """The level whose use gives the smallest sum of squares; 0 for a new sequence."""
        room = self.size - length
        if room == 0:
            return 0
        count = self.count
        cost = 2 * (count[length + 1 : self.size + 1] - count[1 : room + 1]) + 2
        cost[-1] -= 1  # a full sequence leaves the levels
        cost[count[1 : room + 1] == 0] = np.iinfo(np.int64).max
        best = int(len(cost) - 1 - np.argmin(cost[::-1]))  # the fullest of equals
        return best + 1 if cost[best] <= 2 * count[length] + 1 else 0

    def place(self, piece: tuple) -> list[list[tuple]]:
        length = len(piece[2])
        level = self.level_for(length)
        pieces = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        pieces.append(piece)
        if level + length == self.size:
            return [pieces]
        self.open.setdefault(level + length, []).append(pieces)
        self.count[level + length] += 1
        return []

    def close(self) -> Iterator[list[tuple]]:
        """Fill the fullest open sequences with pieces of the emptiest, cut where needed."""
        left = [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        last = len(left) - 1
        first = 0
        while first <= last:
            pieces = left[first]
            room = self.size - sum(len(p[2]) for p in pieces)
            while room and last > first:
                document, start, ids = left[last].pop()
                pieces.append((document, start, ids[:room]))
                if len(ids) > room:
                    left[last].append((document, start + room, ids[room:]))
                room -= min(room, len(ids))
                if not left[last]:
                    last -= 1
            yield pieces
            first += 1
        self.open, self.count = {}, np.zeros(self.size + 1, np.int64)


def padding(length: int, size: int = SEQUENCE) -> int:
    """Padding of a sequence: up to `size`, none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def _pack(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, packer = WordEndIds.of_worker(path), SumOfSquares(size)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(closed: Iterable[list[tuple]]) -> None:
            nonlocal sequence
            for pieces in closed:
                offset = 0
                for (doc, total), start, ids in pieces:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw))
                    offset += len(ids)
                sequence += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            if with_ids:
                names.append("ids")
                columns.append(pa.array([r[7] for r in rows], pa.binary()))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in text_slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            for doc, raw in zip(batch["doc_id"].to_pylist(), codes.encode(texts)):
                ids = np.frombuffer(raw + end, "<u4")
                for start in range(0, len(ids), size):
                    emit(packer.place(((doc, len(ids)), start, ids[start : start + size])))
            if len(rows) > 500:
                yield flush()
        emit(packer.close())
        yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`.

    `tokenizer` is the path of a vocabulary file with word ends, at the same place on every
    executor. A document's ids are followed by `end_id`; every id is in exactly one piece.
    `with_ids` adds the piece's ids as little-endian 32-bit integers.

    A null or empty text is a document of one id. A null id stays null. Repeated rows and
    texts are packed once each row. Long documents are cut at whole sequences. Other columns
    are not read; an empty table gives no pieces. A repeated run over the same partitions
    gives the same pieces, so a lost task can be repeated.

    Texts are encoded as the vocabulary file says, control tokens that they quote included.

    Memory: open sequences of one partition, at most `size` ids each, some 256 KB of text or
    one text, and the words that a worker remembers.
    """
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long"
    ) + (", ids binary" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, size, end_id, with_ids), schema)
