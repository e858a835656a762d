"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words sums their common subsequences of three letters, each gap costing a
factor, so an insult with letters put in between, or with a changed ending, stays close to
the plain one. Landmark words span the space the machine works in. Only documents carry
labels: a sentence is as toxic as its worst word and a document as its worst sentence, so
training alternates between the machine and the choice of the words that make each toxic
document toxic. A word has one number, its margin, and is compared with the landmarks once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.batches import text_slices
from textlens.llm.common import held_out
from textlens.llm.labelled import training_sample
from textlens.llm.phrase_kernel import PhraseMachine, fit_phrases

SAMPLE_ROWS = 3000
LANDMARKS = 64
LONGEST = 24
DECAY = 0.7
#: Distinct words whose numbers a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
#: Triples up to this number are looked up in an array with a place for each.
_DIRECT = 1 << 20
_SIGNS = re.compile(r"[\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _points(words: list[str]) -> np.ndarray:
    """Code points of the words, one row each, zero behind the end."""
    width = max([len(w) for w in words], default=0) or 1
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def subsequence_kernel(a: list[str], b: list[str], decay: float = DECAY, length: int = 3) -> np.ndarray:
    """Kernel of every word of `a` with every word of `b`, before it is normalised."""
    s, t = _points(a), _points(b)
    shape = (len(a), len(b))
    # before[j]: weight of subsequences of one letter less that end before the place in s and
    # before place j in t, each gap up to these places paid for.
    before = [np.ones(shape, np.float32) for _ in range(t.shape[1] + 1)]
    layers = [before] + [[np.zeros(shape, np.float32) for _ in range(t.shape[1] + 1)] for _ in range(length - 1)]
    total = np.zeros(shape, np.float32)
    square = np.float32(decay * decay)
    for i in range(s.shape[1]):
        here = s[:, i]
        same = [(here[:, None] == t[None, :, j]) & (here[:, None] != 0) for j in range(t.shape[1])]
        last = layers[-1]
        for j in range(t.shape[1]):
            if same[j].any():
                total += np.where(same[j], square * last[j], 0)
        for layer in range(length - 1, 0, -1):
            run = np.zeros(shape, np.float32)
            lower, upper = layers[layer - 1], layers[layer]
            for j in range(t.shape[1]):
                run *= np.float32(decay)
                if same[j].any():
                    run += np.where(same[j], square * lower[j], 0)
                upper[j + 1] = np.float32(decay) * upper[j + 1] + run
    return total.astype(np.float64)


class LandmarkKernel:
    """`subsequence_kernel` with fixed words, through a table of their subsequences.

    Three places of a word are looked up at a time; most of them are in no landmark.
    """

    def __init__(self, landmarks: list[str], decay: float = DECAY):
        self.decay = decay
        self.letters = np.unique(_points(landmarks))
        self.letters = self.letters[self.letters > 0]
        self.base = len(self.letters) + 1
        found: dict[int, np.ndarray] = {}
        for m, word in enumerate(landmarks):
            codes, weight = self._triples(_points([word]))
            for code, w in zip(codes[0], weight):
                found.setdefault(int(code), np.zeros(len(landmarks), np.float32))[m] += w
        codes = np.array(sorted(found), np.int64)
        self.weights = np.zeros((len(found) + 1, len(landmarks)), np.float32)
        for i, code in enumerate(codes.tolist(), 1):
            self.weights[i] = found[code]
        self._index(codes)

    def _index(self, codes: np.ndarray) -> None:
        """Rows by triple: one array while the alphabet is small, else a hash table with eight
        places for each, where a triple that finds its place taken goes to the next."""
        self.keys = None
        if self.base**3 <= _DIRECT:
            self.row = np.zeros(self.base**3, np.int32)
            self.row[codes] = np.arange(1, len(codes) + 1)
            return
        bits = max(8, (8 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.row = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for i, (code, at) in enumerate(zip(codes.tolist(), self._place(codes).tolist()), 1):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.row[at] = code, i

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.row[codes]
        flat = codes.ravel()
        at = self._place(flat)
        held = self.keys[at]
        out = np.where(held == flat, self.row[at], 0)
        left = np.flatnonzero((held != flat) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            held = self.keys[at[left]]
            out[left] = np.where(held == flat[left], self.row[at[left]], 0)
            left = left[(held != flat[left]) & (held >= 0)]
        return out.reshape(codes.shape)

    def _triples(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        ids = np.where(self.letters[at] == points, at + 1, 0).astype(np.int32 if self.base**3 <= _DIRECT else np.int64)
        i, j, k = _places(points.shape[1])
        codes = (ids[:, i] * self.base + ids[:, j]) * self.base + ids[:, k]
        codes[(ids[:, i] == 0) | (ids[:, j] == 0) | (ids[:, k] == 0)] = 0
        return codes, np.power(self.decay, k - i + 1).astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.weights.shape[1]), np.float32)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, 200_000 // max(1, int(size) ** 3 // 6))
            for s in range(0, len(at) if size >= 3 else 0, step):
                part = at[s : s + step]
                codes, weight = self._triples(_points([words[i] for i in part]))
                rows = self._rows(codes)
                r, c = np.nonzero(rows)
                if len(r):
                    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    out[part[r[starts]]] = np.add.reduceat(self.weights[rows[r, c]] * weight[c][:, None], starts, axis=0)
        return out


@lru_cache(maxsize=LONGEST + 1)
def _places(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    three = np.array(list(combinations(range(size), 3)), np.int64).reshape(-1, 3)
    return three[:, 0], three[:, 1], three[:, 2]


def self_kernel(words: list[str], decay: float = DECAY) -> np.ndarray:
    """Kernel of each word with itself, words of one length at a time."""
    out = np.zeros(len(words))
    if not words:
        return out
    s = _points(words)
    n, width = s.shape
    first = np.ones((n, width + 1), np.float64)
    second, third = np.zeros((n, width + 1)), np.zeros((n, width + 1))
    for i in range(width):
        same = (s[:, i : i + 1] == s) & (s[:, i : i + 1] != 0)
        out += (decay**2 * third[:, :-1] * same).sum(axis=1)
        for lower, upper in ((second, third), (first, second)):
            run = np.zeros(n)
            for j in range(width):
                run = decay * run + decay**2 * lower[:, j] * same[:, j]
                upper[:, j + 1] = decay * upper[:, j + 1] + run
    return out


def stem(word: str) -> str:
    return _EDGES.sub("", word)


def windows(word: str) -> list[str]:
    """A word and, with signs or digits in it, its letters alone and each run of them, which may
    be a word of its own; a long word comes in overlapping pieces, so that all of it is compared."""
    if word.isalpha():
        return _pieces(word)
    runs = _SIGNS.split(word)
    parts = [word, *(w for w in ("".join(runs), *runs) if len(w) >= 3)]
    return list(dict.fromkeys(p for w in parts for p in _pieces(w)))


def _pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[s : s + LONGEST] for s in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def split_words(text: str) -> list[str]:
    """Lower-case words of the whole text, without the marks behind them.

    Three or more single characters in a row are one word, as in `i d i o t`.
    """
    t = text.lower().replace("\n", " ")
    for mark in ", ", ". ", "! ", "? ":
        t = t.replace(mark, " ")
    words = t.split()
    singles = {i for i, w in enumerate(words) if len(w) == 1 and w.isalnum()}
    if len(singles) < 3:
        return words
    out, i = [], 0
    while i < len(words):
        j = i
        while j in singles:
            j += 1
        if j - i >= 3:
            out.append("".join(words[i:j]))
            i = j
        else:
            out.append(words[i])
            i += 1
    return out


@dataclass
class SentenceMachine:
    landmarks: list[str]
    weights: np.ndarray  # a word's margin is its kernel row times these, plus the bias
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    phrases: PhraseMachine | None = None
    phrase_slope: float = 0.0
    numbers: dict[str, int] = field(default_factory=dict, repr=False)
    values: list[float] = field(default_factory=list, repr=False)

    def __post_init__(self):
        self.rows = LandmarkKernel(self.landmarks)
        self.norms = np.sqrt(self_kernel(self.landmarks))

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel with the landmarks, cubed, which is a kernel too and sharper."""
        own = np.sqrt(self_kernel(words))
        return (self.rows(words) / np.maximum(own[:, None] * self.norms[None, :], 1e-12)) ** 3

    def learn(self, words: set[str]) -> None:
        pieces: list[str] = []
        spans = []
        order = sorted(words)
        for w in order:
            part = windows(stem(w))
            spans.append(len(part))
            pieces += part
        by_size = np.argsort([len(p) for p in pieces], kind="stable")
        value = np.zeros(len(pieces))
        for s in range(0, len(pieces), 4000):
            at = by_size[s : s + 4000]
            value[at] = self.kernel([pieces[i] for i in at]) @ self.weights
        starts = np.cumsum([0] + spans[:-1]) if spans else []
        for w, v in zip(order, np.maximum.reduceat(value, starts) if len(starts) else []):
            self.numbers[w] = len(self.values)
            self.values.append(float(v))

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest margin of any word of each text; the bias for a text without words."""
        split = [split_words(t) for t in texts]
        wanted = {w for words in split for w in words}
        new = wanted.difference(self.numbers)
        if len(self.values) + len(new) > REMEMBERED:
            self.numbers.clear()
            self.values.clear()
            new = wanted
        self.learn(new)
        values = np.array(self.values)
        out = np.zeros(len(texts))
        for i, words in enumerate(split):
            if words:
                out[i] = values[np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))].max()
        return out + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.slope * self.margins(texts) + self.shift
        if self.phrases is not None:
            z = z + self.phrase_slope * self.phrases.margins(texts)
        return 0.5 * (1 + np.tanh(0.5 * z))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], n: int = LANDMARKS) -> list[str]:
    """Words by how much more often toxic documents hold them, each unlike those before it;
    the last quarter are the commonest words of clean documents. Ties go by name."""
    bad, good = Counter(w for d in toxic for w in d), Counter(w for d in clean for w in d)
    usual = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3][: n // 4]
    gain = {w: c / len(toxic) - 2 * good[w] / max(1, len(clean)) for w, c in bad.items() if 3 <= len(w) <= LONGEST and c > 1}
    ranked = sorted(gain, key=lambda w: (-gain[w], w))[: 20 * n]
    chosen: list[str] = []
    if ranked:
        value = np.array([gain[w] for w in ranked])
        own = np.sqrt(self_kernel(ranked))
        near = np.zeros(len(ranked))
        while len(chosen) < min(n - len(usual), len(ranked)):
            k = int(np.argmax(value * (1 - near)))
            if value[k] <= 0 or near[k] > 0.9:
                break
            chosen.append(ranked[k])
            row = subsequence_kernel(ranked, [ranked[k]])[:, 0] / np.maximum(own * own[k], 1e-12)
            near = np.maximum(near, row)
            near[k] = 1
    return chosen + [w for w in usual if w not in chosen]


def _fit_svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 100.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, rows weighed by `share`, by accelerated gradient."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    gram = (z * share[:, None]).T @ z
    rate = 1 / (2 * cost * np.linalg.eigvalsh(gram)[-1] + 1e-3)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        after = v - rate * (1e-3 * v - 2 * cost * (z.T @ (share * slack * y)))
        v = after + k / (k + 3) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def fit_machine(texts: list[str], y: np.ndarray, rounds: int = 3) -> SentenceMachine:
    """Train on the words of sentences, and for toxic texts that no word gives away on sentences
    as rows of words, with the labels of their documents. One label only, or no text, gives a
    machine that says that label's share for every text."""
    stems = [{p for s in map(stem, set(split_words(t))) for p in windows(s) if len(p) >= 3} for t in texts]
    toxic = [d for d, l in zip(stems, y) if l == 1 and d]
    clean = [d for d, l in zip(stems, y) if l == 0 and d]
    if not toxic or not clean:
        share = (int((y == 1).sum()) + 0.5) / (len(texts) + 1) if len(texts) else 0.5
        return SentenceMachine(["aaa"], np.zeros(1), 0.0, 0.0, float(np.log(share / (1 - share))))
    landmarks = choose_landmarks(toxic, clean)
    machine = SentenceMachine(landmarks, np.zeros(len(landmarks)), 0.0)
    value, vector = np.linalg.eigh(machine.kernel(landmarks))
    to_space = vector / np.sqrt(np.maximum(value, 1e-3))  # Nyström map

    vocabulary = sorted({w for d in stems for w in d})
    number = {w: i for i, w in enumerate(vocabulary)}
    x = np.concatenate([machine.kernel(vocabulary[s : s + 4000]) @ to_space for s in range(0, len(vocabulary), 4000)])
    in_clean, in_toxic = np.zeros(len(x)), np.zeros(len(x))
    for docs, count in ((clean, in_clean), (toxic, in_toxic)):
        for d in docs:
            count[[number[w] for w in d]] += 1
    bags = [np.array(sorted(number[w] for w in d)) for d in toxic]
    margin = in_toxic / len(toxic) - 2 * in_clean / len(clean)
    sure = np.zeros(len(x), bool)
    for k in range(rounds):
        # the worst word of every toxic document, and all others that are as bad as a threat;
        # at first, those that are nearly as telling as its worst
        blamed = np.where(sure, in_toxic, 0.0).astype(float)
        for bag in bags:
            worst = np.argmax(margin[bag])
            blamed[bag[worst]] += 1
            if k == 0:
                blamed[bag[(margin[bag] >= 0.5 * margin[bag[worst]]) & (in_toxic[bag] > 1)]] += 1
        blamed[in_clean > 0] = 0
        harmless = np.where(blamed > 0, 0, in_clean + 0.1 * in_toxic)
        rows = np.flatnonzero((blamed > 0) | (harmless > 0))
        label = np.where(blamed[rows] > 0, 1.0, -1.0)
        share = np.where(label > 0, np.sqrt(blamed[rows]), np.sqrt(harmless[rows]))
        share /= np.where(label > 0, share[label > 0].sum(), share[label < 0].sum()) * 2
        w, b = _fit_svm(x[rows], label, share)
        margin = x @ w + b
        sure = (margin > 0.5) & (in_clean == 0) & (in_toxic > 1)
    machine.weights, machine.bias = to_space @ w, b
    margin = machine.margins(texts)
    machine.slope, machine.shift = _platt(margin[:, None], y)
    # toxic texts whose worst word is no worse than that of some clean ones
    missed = (y == 1) & (margin <= np.quantile(margin[y == 0], 0.98))
    machine.phrases = fit_phrases(texts, y, missed, _fit_svm)
    if machine.phrases is not None:
        both = np.stack([margin, machine.phrases.margins(texts)], axis=1)
        machine.slope, machine.phrase_slope, machine.shift = _platt(both, y)
    machine.numbers.clear()
    machine.values.clear()
    return machine


def _platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> list[float]:
    """Logistic curve of the margins, by Newton steps, with softened targets: a slope for each
    margin, none of them negative, and the shift."""
    n, p = (y == 0).sum(), (y == 1).sum()
    target = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    z = np.hstack([margins, np.ones((len(margins), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        q = 0.5 * (1 + np.tanh(0.5 * (z @ w)))
        hessian = (z * (q * (1 - q) + 1e-9)[:, None]).T @ z + 1e-3 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, z.T @ (q - target) + 1e-3 * w), -1, 1)
    return [*(max(float(x), 0.0) for x in w[:-1]), float(w[-1])]


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> SentenceMachine:
    """Fit on at most about `sample_rows` labelled documents, half of each label.

    The bound keeps the driver's share constant.
    """
    sample = training_sample(docs, labels, label, sample_rows, id_col, text_col, longest=100_000, balanced=True)
    rows = sorted((r["text"], r["y"]) for r in sample.collect())
    return fit_machine([t for t, _ in rows], np.array([y for _, y in rows], int))


_MACHINES: dict[str, SentenceMachine] = {}


def _scored(machine: SentenceMachine, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MACHINES:  # remembered words serve the worker's next tasks too
            _MACHINES.clear()
            _MACHINES[name] = machine
        mine = _MACHINES[name]
        for part in text_slices(batches, size=1 << 20, rows=500):
            scores = mine.scores([t or "" for t in part["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score_toxicity(docs: DataFrame, machine: SentenceMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, score` for every row: the probability of label 1, from the whole text alone.

    A text is as toxic as its worst word and its worst sentence. A null text is scored as an
    empty one; texts of any length are scored whole, a slice at a time.
    Null ids and repeated rows are kept; other columns are not read; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = f"{machine.landmarks}{machine.weights.tolist()}{machine.bias}{machine.slope}{machine.shift}{machine.phrase_slope}"
    return rows.mapInArrow(_scored(machine, name), f"id {dict(rows.dtypes)['id']}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every document."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, **options))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
