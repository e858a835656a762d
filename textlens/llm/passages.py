"""Passages of whole texts as vectors of character and word statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PASSAGE = 1024
_KINDS = 9
WIDTH = _KINDS + _KINDS * _KINDS + 8
_AT_ONCE = 1_000_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of a code point: lower, upper, digit, blank, line end, stop, comma, ASCII sign, other."""
    out = np.full(1 << 16, 8, np.int64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            out[i] = 2
        elif c in "\n\r":
            out[i] = 4
        elif c.isspace():
            out[i] = 3
        elif c == ".":
            out[i] = 5
        elif c == ",":
            out[i] = 6
        elif i < 128:
            out[i] = 7
    return out


def _encode(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row for each run of `lengths` code points."""
    n = len(lengths)
    at = np.repeat(np.arange(n), lengths)
    kind = _kinds()[np.minimum(points, (1 << 16) - 1)]
    single = np.bincount(at * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    inner = at[1:] == at[:-1]
    code = at[1:] * _KINDS * _KINDS + kind[:-1] * _KINDS + kind[1:]
    pairs = np.bincount(code[inner], minlength=n * _KINDS * _KINDS).reshape(n, -1)

    dark = np.flatnonzero((kind != 3) & (kind != 4))
    gap = np.ones(len(dark), bool)
    gap[1:] = (np.diff(dark) > 1) | (at[dark[1:]] != at[dark[:-1]])
    starts = np.flatnonzero(gap)
    words = np.zeros(n, np.int64)
    extra = np.zeros((n, 8))
    if len(starts):
        place = np.arange(len(dark)) - np.repeat(starts, np.diff(np.append(starts, len(dark))))
        mixed = (points[dark].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= 2 * place.astype(np.uint64) + np.uint64(1)
        word = np.add.reduceat(mixed, starts)
        size = np.diff(np.append(starts, len(dark)))
        home = at[dark[starts]]
        words = np.bincount(home, minlength=n)
        again = (word[1:] == word[:-1]) & (home[1:] == home[:-1])
        seen = np.zeros(n * 256, bool)
        seen[home * 256 + ((word * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(np.int64)] = True
        last = kind[dark[np.append(starts[1:], len(dark)) - 1]]
        total = np.maximum(words, 1)
        extra[:, 1] = np.bincount(home, size, n) / total
        extra[:, 2] = np.sqrt(np.maximum(np.bincount(home, size.astype(float) ** 2, n) / total - extra[:, 1] ** 2, 0))
        extra[:, 3] = np.bincount(home[1:], again, n) / total
        extra[:, 4] = seen.reshape(n, 256).sum(axis=1) / np.minimum(total, 256)
        extra[:, 5] = np.bincount(home, kind[dark[starts]] == 1, n) / total
        extra[:, 6] = np.bincount(home, last >= 7, n) / total
    some = np.maximum(lengths, 1)[:, None]
    extra[:, 0] = np.log1p(lengths)
    extra[:, 7] = np.log1p(words)
    return np.concatenate([single / some, pairs / some, extra], axis=1).astype(np.float32)


def encode_passages(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text a matrix with a row for each passage; a null or empty text has one row.

    Passages are runs of 1024 code points and cover the whole text. Texts are worked off
    about a million code points at a time, within long texts too.
    """
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        if not waiting:
            return
        lengths = np.concatenate([_cuts(len(p)) for _, p in waiting])
        rows = _encode(np.concatenate([p for _, p in waiting]), lengths)
        yield from np.split(rows, np.cumsum([len(_cuts(len(p))) for _, p in waiting])[:-1])
        waiting.clear()

    for text in texts:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        if held + len(points) > _AT_ONCE:
            yield from flush()
            held = 0
        if len(points) > _AT_ONCE:
            step = _AT_ONCE // PASSAGE * PASSAGE
            yield np.concatenate([_encode(points[s : s + step], _cuts(len(points[s : s + step]))) for s in range(0, len(points), step)])
            continue
        waiting.append((0, points))
        held += len(points)
    yield from flush()


def _cuts(length: int) -> np.ndarray:
    whole, rest = divmod(length, PASSAGE)
    return np.array([PASSAGE] * whole + ([rest] if rest or not whole else []), np.int64)
