"""Subsequence kernel over the words of sentences, with landmark sentences.

An instance is a sentence, or a window of `SPAN` words of a longer one. Its features are three
words in order, with any words between them, each occurrence weighed by `DECAY` for every
place it spans: a phrase is known again with words put in. The kernel with a landmark is found from
a table of the triples that occur in landmarks, so its size does not depend on the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

SPAN, STEP, DECAY = 12, 4, 0.7
LANDMARKS = 24
#: A second machine needs as many missed toxic texts, and this share of all toxic ones: what few
#: texts have in common is chance.
LEAST_MISSED, MISSED_SHARE = 20, 0.1
_TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of every sentence or line."""
    out: list[list[str]] = [[]]
    for token in _TOKENS.findall(text.lower()):
        if token in _ENDS:
            if out[-1]:
                out.append([])
        else:
            out[-1].append(token)
    return out if out[-1] else out[:-1]


def word_kernel(a: np.ndarray, b: np.ndarray) -> float:
    """Kernel of two sequences of word numbers: common triples, weighed by their spans."""
    same = a[:, None] == b[None, :]
    first = np.ones((len(a) + 1, len(b) + 1))
    layers = [first, np.zeros_like(first), np.zeros_like(first)]
    total = 0.0
    for i in range(len(a)):
        total += DECAY**2 * float(layers[2][i, :-1] @ same[i])
        for upper in (2, 1):
            run = 0.0
            for j in range(len(b)):
                run = DECAY * run + (DECAY**2 * layers[upper - 1][i, j] if same[i, j] else 0.0)
                layers[upper][i + 1, j + 1] = DECAY * layers[upper][i, j + 1] + run
    return total


def _in(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The place of each code, -1 where it is missing."""
    if not len(sorted_codes):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, at, -1)


class PhraseRows:
    """Normalised kernel rows of the instances of texts with fixed landmarks."""

    def __init__(self, landmarks: list[list[str]]):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for l in landmarks for w in l), 1)}
        self.base = len(self.number) + 1
        found: dict[int, np.ndarray] = {}
        self.norms = np.zeros(len(landmarks))
        for m, words in enumerate(landmarks):
            ids = np.array([self.number[w] for w in words])
            self.norms[m] = np.sqrt(word_kernel(ids, ids))
            for i in range(len(ids)):
                for j in range(i + 1, len(ids)):
                    for k in range(j + 1, len(ids)):
                        code = int((ids[i] * self.base + ids[j]) * self.base + ids[k])
                        found.setdefault(code, np.zeros(len(landmarks)))[m] += DECAY ** (k - i + 1)
        self.triples = np.array(sorted(found), np.int64)
        self.pairs = np.unique(self.triples // self.base)
        self.weights = np.array([found[c] for c in self.triples.tolist()]).reshape(-1, len(landmarks))

    def _hits(self, ids: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triples of landmarks in a row of words: first place, last place, which."""
        known = np.flatnonzero(ids)
        parts = [(known[:0], known[:0], known[:0])]
        for d in range(1, SPAN - 1):
            i = known[known + d < len(ids)]
            i = i[(ids[i + d] > 0) & (sentence[i + d] == sentence[i])]
            pair = ids[i] * self.base + ids[i + d]
            near = _in(self.pairs, pair) >= 0
            i, pair = i[near], pair[near]
            for e in range(1, SPAN - d):
                k = i + d + e
                fits = k < len(ids)
                fits[fits] &= (ids[k[fits]] > 0) & (sentence[k[fits]] == sentence[i[fits]])
                which = _in(self.triples, pair[fits] * self.base + ids[k[fits]])
                parts.append((i[fits][which >= 0], k[fits][which >= 0], which[which >= 0]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text and the kernel row of every instance that shares a triple with a landmark."""
        words: list[str] = []
        of_text, starts = [], []
        for t, text in enumerate(texts):
            for sentence in sentences(text):
                starts.append(len(words))
                of_text.append(t)
                words += sentence
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        starts = np.array(starts, np.int64)
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        first, last, which = self._hits(ids, sentence)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros((0, len(self.norms)))
        begins, s = starts[sentence[first]], []
        for back in range(SPAN // STEP):
            window = begins + (first - begins) // STEP * STEP - back * STEP
            inside = (window >= begins) & (last < window + SPAN)
            s.append((window[inside], np.flatnonzero(inside)))
        window, hit = (np.concatenate(x) for x in zip(*s))
        order = np.argsort(window, kind="stable")
        window, hit = window[order], hit[order]
        new = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        value = self.weights[which[hit]] * (DECAY ** (last[hit] - first[hit] + 1))[:, None]
        rows = np.add.reduceat(value, new, axis=0)
        own = np.zeros(len(new))
        for r, w in enumerate(window[new].tolist()):
            stop = min(w + SPAN, len(words))
            part = words[w : w + int((sentence[w:stop] == sentence[w]).sum())]
            seen = {x: k for k, x in enumerate(part)}
            numbers = np.array([seen[x] for x in part])
            own[r] = self._spread(len(part)) if len(seen) == len(part) else np.sqrt(word_kernel(numbers, numbers))
        text = np.array(of_text)[sentence[window[new]]]
        return text, rows / np.maximum(own[:, None] * self.norms[None, :], 1e-12)

    def _spread(self, n: int) -> float:
        """Norm of a row of different words: a triple that spans m places has m - 2 middles."""
        return float(np.sqrt(sum((n - m + 1) * (m - 2) * DECAY ** (2 * m) for m in range(3, n + 1))))


@dataclass
class PhraseMachine:
    """Margins of sentences: kernel rows times weights, plus a bias."""

    landmarks: list[list[str]]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.rows = PhraseRows(self.landmarks)

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest margin of any sentence of each text; the bias without a common triple."""
        text, rows = self.rows(texts)
        out = np.zeros(len(texts))
        np.maximum.at(out, text, rows @ self.weights)
        return out + self.bias


def _codes(words: list[str], apart: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words up to three places apart, as numbers, and the place of the first."""
    ids = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    codes = [(ids[:-d] << np.uint64(32)) | ids[d:] for d in range(1, apart + 1) if d < len(ids)]
    places = [np.arange(len(ids) - d) for d in range(1, apart + 1) if d < len(ids)]
    return (np.concatenate(codes), np.concatenate(places)) if codes else (ids[:0], np.zeros(0, np.int64))


def _document_pairs(text: str) -> np.ndarray:
    found = [_codes(s)[0] for s in sentences(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def choose_phrases(toxic: list[str], clean: list[str], n: int = LANDMARKS) -> list[list[str]]:
    """Stretches of toxic sentences with the pairs of words that toxic documents hold more often,
    each unlike those before it, trimmed to these pairs. None if no pair is in three of them."""
    pairs, counts = np.unique(np.concatenate([_document_pairs(t) for t in toxic] or [np.zeros(0, np.uint64)]), return_counts=True)
    pairs, counts = pairs[counts >= 3], counts[counts >= 3]
    if not len(pairs):
        return []
    harmless = np.zeros(len(pairs))
    for text in clean:
        at = _in(pairs, _document_pairs(text))
        harmless[at[at >= 0]] += 1
    gain = counts / len(toxic) - 2 * harmless / max(1, len(clean))
    pairs, gain = pairs[gain > 0], gain[gain > 0]
    best: dict[tuple[str, ...], float] = {}
    for text in toxic:
        top: tuple[float, tuple[str, ...]] = (0.0, ())
        for sentence in sentences(text):
            codes, places = _codes(sentence)
            at = _in(pairs, codes)
            places, at = places[at >= 0], at[at >= 0]
            for first in np.unique(places).tolist():
                inside = (places >= first) & (places < first + SPAN - 3)
                value = float(gain[at[inside]].sum())
                if value > top[0]:
                    stop = int(places[inside].max()) + 2
                    top = (value, tuple(sentence[first : max(stop, first + 3)][:SPAN]))
        if len(top[1]) >= 3:
            best[top[1]] = max(best.get(top[1], 0.0), top[0])
    chosen: list[list[str]] = []
    for words in sorted(best, key=lambda w: (-best[w], w)):
        if len(chosen) == n:
            break
        if chosen:
            _, rows = PhraseRows(chosen)([" ".join(words)])
            if len(rows) and rows.max() > 0.9:
                continue
        chosen.append(list(words))
    return chosen


def fit_phrases(texts: list[str], y: np.ndarray, missed: np.ndarray, fit_svm, rounds: int = 3) -> PhraseMachine | None:
    """A machine for the sentences of toxic texts that were missed; None if these are few or share
    no phrase."""
    if missed.sum() < max(LEAST_MISSED, MISSED_SHARE * (y == 1).sum()):
        return None
    toxic = [t for t, m in zip(texts, missed) if m]
    clean = [t for t, l in zip(texts, y) if l == 0]
    landmarks = choose_phrases(toxic, clean) if toxic and clean else []
    if not landmarks:
        return None
    rows = PhraseRows(landmarks)
    value, vector = np.linalg.eigh(_gram(landmarks, rows))
    to_space = vector / np.sqrt(np.maximum(value, 1e-3))
    bad_text, bad = rows(toxic)
    _, good = rows(clean)
    bad, good = bad @ to_space, np.vstack([good @ to_space, np.zeros((1, len(landmarks)))])
    margin = bad.sum(axis=1)
    for _ in range(rounds):
        worst = {}
        for at in np.argsort(margin, kind="stable").tolist():
            worst[int(bad_text[at])] = at
        chosen = bad[sorted(worst.values())]
        x = np.vstack([chosen, good])
        label = np.append(np.ones(len(chosen)), -np.ones(len(good)))
        share = np.append(np.full(len(chosen), 0.5 / len(chosen)), np.full(len(good), 0.5 / len(good)))
        w, b = fit_svm(x, label, share)
        margin = bad @ w + b
    return PhraseMachine(landmarks, to_space @ w, b)


def _gram(landmarks: list[list[str]], rows: PhraseRows) -> np.ndarray:
    ids = [np.array([rows.number[w] for w in l]) for l in landmarks]
    full = np.array([[word_kernel(a, b) for b in ids] for a in ids])
    return full / np.maximum(rows.norms[:, None] * rows.norms[None, :], 1e-12)
