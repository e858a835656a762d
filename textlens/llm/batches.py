"""Arrow batches cut by the bytes of their texts, so that a task's memory does not depend on their rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time, unless one text alone is longer.
SLICE_BYTES = 1 << 18


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int = 1000
) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows whose texts have `size` bytes in all, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = min(max(stop, first + 1), first + rows, batch.num_rows)
            yield batch.slice(first, stop - first)
            first = stop
