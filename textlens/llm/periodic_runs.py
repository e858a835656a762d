"""Detection of periodic runs of words: seeds on a diagonal, extended as far as they go.

A run of period q is at least `LEAST` words and four periods long, so on the diagonal of lag
q (word i against word i + q) it is a stretch of at least max(LEAST, 4 q) - q equal pairs.
Lags are taken in classes from one power of two to the next; k, the least stretch of a class,
is the length of its k-grams. Within a run a k-gram comes back after q words, and not sooner,
because k >= q and a sooner return would be a smaller period. So it is enough to pair each
occurrence with the next one in its document: a sort, and no more pairs than words.

Pairs of the class's lags are seeds. A table with an entry a lag holds how far that diagonal
was covered; a seed in the covered part is not extended again.

K-grams are named exactly, by names of their halves, many documents at a time. What occurs
once in its document has no name, so that almost nothing is left after a few words of prose.
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

#: The shortest run in words, and in periods.
LEAST, PERIODS = 6, 4
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def guaranteed(lag: int) -> int:
    """Equal pairs on the diagonal of a run of this period, at least."""
    return max(LEAST, PERIODS * lag) - lag


def _names(keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal keys, and -1 for a key that occurs once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    group = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(np.bincount(group)[group] > 1, group, -1)
    return out


class _Grams:
    """Names of the repeated grams of some documents; their length doubles as asked for."""

    def __init__(self, words: np.ndarray):
        self.words, self.length = words, 1
        self.at, self.names = self._kept(np.arange(len(words)), _names(words))

    def _kept(self, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of repeated grams, and a name for every place (-1: not repeated)."""
        every = np.full(len(self.words) + 1, -1, np.int64)
        every[at] = names
        return at[names >= 0], every

    def _joined(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a gram meets another, `shift` words on, and names of the two together."""
        other = self.names[np.minimum(self.at + shift, len(self.words))]
        at, other = self.at[other >= 0], other[other >= 0]
        return at, _names(self.names[at] * (len(self.words) + 1) + other)

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the repeated grams of this length, and their names."""
        while 2 * self.length <= length:
            self.at, self.names = self._kept(*self._joined(self.length))
            self.length *= 2
        at, names = self._joined(length - self.length)
        return at[names >= 0], names[names >= 0]


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The equal pairs around one on a diagonal: first place, and the place behind the last."""

    def equal(first: int, size: int) -> np.ndarray:
        return words[first : first + size] == words[first + lag : first + lag + size]

    stop, step = at, 64
    while stop < len(words) - lag:
        same = equal(stop, min(step, len(words) - lag - stop))
        if not same.all():
            stop += int(same.argmin())
            break
        stop, step = stop + len(same), 2 * step
    start, step = at, 64
    while start > 0:
        size = min(step, start)
        same = equal(start - size, size)[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = start - size, 2 * step
    return start, stop


def runs_of(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """`(start, length, period)` of all runs, in order of start, then period.

    `words` are numbers, the same for equal words of one document; documents stand one after
    the other, share no number and have `longest` words at most.
    """
    grams, found = _Grams(words), []
    low = 1
    while max(LEAST, PERIODS * low) <= longest:
        k = min(guaranteed(low), guaranteed(2 * low - 1))
        at, names = grams.of(k)
        if not len(grams.at):
            break
        order = np.argsort(names, kind="stable")  # places ascend within a name
        here, following = at[order][:-1], at[order][1:]
        lag = following - here
        seed = (names[order][:-1] == names[order][1:]) & (lag >= low) & (lag < 2 * low)
        here, lag = here[seed], lag[seed]
        order = np.lexsort((here, lag))
        covered: dict[int, int] = {}
        for place, q in zip(here[order].tolist(), lag[order].tolist()):
            if place < covered.get(q, 0):
                continue
            start, stop = _stretch(words, place, q)
            covered[q] = stop
            if stop - start >= guaranteed(q):
                found.append((start, stop - start + q, q))
        low *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def _numbers(words: list[list[str]]) -> np.ndarray:
    """Words as numbers that are the same only for equal words of one document."""
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64)
    document = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    return flat * len(words) + document


def text_runs(texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[str]]]:
    """For each text its runs, and the words that stay when repeats are dropped."""
    words = [_WORDS.findall(t) for t in texts]
    sizes = [len(ws) for ws in words]
    ends = np.cumsum(sizes)
    numbers = _numbers(words)
    per_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stays = np.ones(len(numbers), bool)
    for start, length, period in runs_of(numbers, max(sizes, default=0)) if len(numbers) else []:
        text = int(np.searchsorted(ends, start, side="right"))
        per_text[text].append((start - int(ends[text]) + sizes[text], length, period))
        stays[start + period : start + length] = False
    out = []
    for ws, runs, end in zip(words, per_text, ends.tolist()):
        if runs:
            ws = [w for w, stay in zip(ws, stays[end - len(ws) : end].tolist()) if stay]
        out.append((runs, ws))
    return out


_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        found = text_runs([t or "" for t in part["text"].to_pylist()])
        runs = [[dict(zip(("start", "length", "period"), run)) for run in rs] for rs, _ in found]
        yield pa.RecordBatch.from_arrays(
            [part["id"], pa.array(runs, _RUN_TYPE), pa.array([" ".join(ws) for _, ws in found], pa.string())],
            ["id", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`<id_col>, runs, collapsed` of every row.

    `runs` holds `(start, length, period)` of every run in words, by start, then period: at
    least six words and four periods of the smallest period, extended to both sides as far as
    the period holds. `collapsed` is the words, joined by blanks, without those that a run
    contains after its first period.

    Words are what blanks (space, tab to carriage return) separate, compared as written. A
    null or empty text has no runs and an empty `collapsed`. Ids are carried along: null and
    repeated ones stay, each row for its own text. Runs may overlap, and several may start at
    one word with different periods; all are listed. Texts of any length are searched whole:
    a task holds some 256 KB of text or one text, and a few numbers for each of its words.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_find, f"id {kind}, runs {_RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def longest_run(runs: Column) -> Column:
    """The longest of an array of runs; of equals the one with the smallest start, then period."""
    ranked = F.transform(
        runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    )
    best = F.array_max(ranked)
    return F.when(
        best.isNotNull(),
        F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")),
    )


def runs_text(runs: Column) -> Column:
    """`start,length,period` and a line end for each run."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")


def with_repeats(text: Column, key: Column) -> Column:
    """Texts in which a stretch of words of every tenth key is replaced by repeats of its start.

    With h the CRC-32 of the key as a string and g = h / 10, rounded down: where h divides by
    ten, every word from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    Such texts are their words, joined by blanks; all others, and those without words or with
    a null key, are as they were, but for null, which is empty.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))  # without words nothing changes
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    repeats = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeats), " ")
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), changed).otherwise(text)
