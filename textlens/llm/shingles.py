"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_GOLDEN = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_GOLDEN)) | np.uint64(1)


_BYTE = _numbers(256, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _numbers(WORDS, 1 << 20)
_SHORT = _numbers(WORDS, 1 << 21)


def _chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    blank = _BLANK[raw]
    dark = np.flatnonzero(~blank)
    empty = np.zeros(0, np.uint64)
    if not len(dark):
        return [empty] * len(texts)
    first = np.flatnonzero(np.append(True, np.diff(dark) > 1))
    size = np.diff(np.append(first, len(dark)))
    place = np.arange(len(dark)) - np.repeat(first, size)
    by_place = _numbers(int(size.max()), 1 << 22)
    word = mix(np.add.reduceat(_BYTE[raw[dark]] * by_place[place], first) + size.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    stop = np.searchsorted(dark[first], ends)  # words of the texts so far
    start = np.append(0, stop[:-1])
    running = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS if len(running) else 0):
        running += word[k : len(word) - WORDS + 1 + k] * _PLACE[k]
    running = mix(running)
    out = []
    for a, b in zip(start.tolist(), stop.tolist()):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(running[a : b - WORDS + 1]))
        elif n:
            out.append(mix((word[a:b] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _SHORT[n]))
        else:
            out.append(empty)
    return out


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The set of each text: hashes of every five words in a row, A-Z lower-cased.

    A text of fewer words is one shingle; one without words, or null, has none. Words are
    what blanks (space, tab to carriage return) separate. Two different shingles of one
    table have the same hash with a chance of 2**-64 a pair.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size > _CHUNK:
            yield from _chunk_sets(held)
            held, size = [], 0
    if held:
        yield from _chunk_sets(held)


def fingerprints(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed numbers."""
    one = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mix(shingles ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bits, packed in bytes: in each, whether an odd number of shingles falls on it.

    There are about as many bits as shingles, a power of two from 256 up. Sets that differ
    in d shingles differ in at most d bits, also after `fold`.
    """
    bits = max(256, 1 << max(0, len(shingles) - 1).bit_length())
    at = (mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def fold(packed: np.ndarray, size: int) -> np.ndarray:
    """Parities in `size` bytes, fewer by a power of two."""
    while len(packed) > size:
        half = len(packed) // 2
        packed = packed[:half] ^ packed[half:]
    return packed
