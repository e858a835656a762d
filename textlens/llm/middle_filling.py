"""Fill-in-middle transformation: texts cut at two unit ranks and put in another order.

A text is a row of units (a word with the blanks before it, or blanks at the end). The cut
ranks count units, the cuts are needed in code points. An indexable skip list answers that:
every link of every lane carries how many units and how many code points it passes, so that
descending from the sparsest lane, taking each link that does not pass the rank, reaches
exactly the unit asked for and has added up its place in the text on the way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.batches import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class SkipList:
    """Units by their code-point widths, with lanes that skip over ever more of them.

    A lane is two arrays with one element a link: the units and the code points that the
    link passes, and `below`, the place in the next denser lane where the link starts. A
    link of a lane joins links of the lane below; how many, two to five, follows from a
    fixed sequence, so that equal texts have equal lists.
    """

    def __init__(self, widths: np.ndarray):
        units = np.ones(len(widths), np.int64)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(units, widths, np.arange(len(widths)))]
        while len(units) > 8:
            step = 2 + (np.arange(len(units) // 2 + 1) * 2654435761 >> 7) % 4
            first = np.cumsum(step) - step
            first = first[first < len(units)]
            units, widths = np.add.reduceat(units, first), np.add.reduceat(widths, first)
            self.lanes.append((units, widths, first))

    def __len__(self) -> int:
        return int(self.lanes[-1][0].sum())

    def code_points_before(self, rank: int) -> int:
        """Code points of the first `rank` units."""
        at, left, passed = 0, rank, 0
        for depth in range(len(self.lanes) - 1, -1, -1):
            units, widths, below = self.lanes[depth]
            while at < len(units) and units[at] <= left:
                left -= int(units[at])
                passed += int(widths[at])
                at += 1
            if not left:
                return passed
            at = int(below[at])
        raise IndexError(rank)


def unit_list(text: str) -> SkipList:
    ends = np.fromiter((m.end() for m in _UNIT.finditer(text)), np.int64)
    return SkipList(np.diff(ends, prepend=0))


def _draws(seed: int, key: str) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(text: str, key: str, seed: int, percent: int, suffix_first: int) -> tuple:
    """`n, form, prefix_chars, middle_chars, output` of one text."""
    units = unit_list(text)
    n = len(units)
    one, two, chance, order = _draws(seed, key)
    marked = PREFIX in text or SUFFIX in text or MIDDLE in text
    if not text or marked or chance % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = units.code_points_before(low), units.code_points_before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _transform(seed: int, percent: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts, keys = part["text"].to_pylist(), part["key"].to_pylist()
            rows = [transformed(t or "", k, seed, percent, suffix_first) for t, k in zip(texts, keys)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([part["id"], *columns], ["id", *_NAMES])

    return run


_NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    percent: int = 50,
    suffix_first: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`<id_col>, n, form, prefix_chars, middle_chars, output` of every row.

    `n` counts units. The draws of a row are the first four 32-bit numbers of the SHA-256 of
    `seed:id`: two give the cuts, the third whether the text is cut at all (`percent` of them
    are), the fourth whether the suffix stands first (form `spm`, `suffix_first` percent) or
    the prefix (`psm`). A text that is empty or null, or that quotes one of the marks, stays
    as it is (`plain`, null widths). `original` takes an output apart again.

    A null id draws as the word `null` and stays null. Repeated rows, and rows that share
    an id, are each cut by their own text. A text without blanks is one unit; a cut may leave
    any part empty. Texts of any length are cut whole; a task holds some 256 KB of text or one
    text, and its units. Other columns are not read; an empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        _transform(seed, percent, suffix_first),
        f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )
    return found.withColumnRenamed("id", id_col)


def original(output: Column, form: Column) -> Column:
    """The text that was transformed, from an output and its form.

    A cut text holds no mark, and a mark cannot arise where a part meets one, so each mark
    is found once.
    """

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def behind(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, -1)

    psm = F.concat(
        before(behind(output, PREFIX), SUFFIX), behind(output, MIDDLE), before(behind(output, SUFFIX), MIDDLE)
    )
    spm = F.concat(
        before(behind(output, PREFIX), MIDDLE), behind(output, MIDDLE), before(behind(output, SUFFIX), PREFIX)
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
