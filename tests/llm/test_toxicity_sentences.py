"""Toxicity by sentences: kernels and margins against plain versions, phrases of ordinary words."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import toxicity_ssk
from textlens.llm.common import held_out
from textlens.llm.labelled import training_sample
from textlens.llm.phrase_kernel import DECAY, SPAN, STEP, PhraseMachine, PhraseRows, sentences, word_kernel
from textlens.llm.toxicity_ssk import LandmarkKernel, fit_machine, subsequence_kernel, toxicity_scores


def plain_kernel(a, b):
    """Every three places of one with every equal three of the other."""
    return sum(
        DECAY ** (x[2] - x[0] + 1 + z[2] - z[0] + 1)
        for x in combinations(range(len(a)), 3)
        for z in combinations(range(len(b)), 3)
        if [a[i] for i in x] == [b[i] for i in z]
    )


def test_word_kernel():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert word_kernel(np.array(a, int), np.array(b, int)) == pytest.approx(plain_kernel(a, b))


def windows_of(text):
    for words in sentences(text):
        for start in range(0, len(words), STEP):
            yield words[start : start + SPAN]


def test_margins_equal_a_plain_machine():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(9)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    landmarks = [some(rng.randint(3, 9)) for _ in range(5)]
    machine = PhraseMachine(landmarks, np.array([1.0, -0.5, 2.0, 0.3, -1.0]), -0.25)
    texts = ["", "w1", "w0 w1 w2.", "Zebra! crossing\n"] + [
        "".join(rng.choice([" ", " ", " ", ", ", ". ", "\n"]) + rng.choice([*vocabulary, "x", "Y"]) for _ in range(rng.randint(0, 60))) for _ in range(40)
    ]
    got = machine.margins(texts)
    for text, margin in zip(texts, got):
        best = 0.0
        for words in windows_of(text):
            own = plain_kernel(words, words)
            row = [plain_kernel(words, l) / np.sqrt(own * plain_kernel(l, l)) if own else 0.0 for l in landmarks]
            if any(row):
                best = max(best, float(np.array(row) @ machine.weights))
        assert margin == pytest.approx(best - 0.25), text


def test_landmark_table_does_not_grow_with_the_alphabet(monkeypatch):
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    landmarks = ["".join(rng.sample(letters, 6)) for _ in range(64)]
    table = LandmarkKernel(landmarks)
    assert table.row.nbytes + table.keys.nbytes < 4_000_000
    words = landmarks[:20] + [w[::-1] for w in landmarks[:5]] + ["".join(rng.choice(letters) for _ in range(8)) for _ in range(50)] + [w[:3] + "x" + w[3:] for w in landmarks[:9]]
    assert np.allclose(table(words), subsequence_kernel(words, landmarks), rtol=1e-5, atol=1e-6)
    small = ["idiot", "stupid", "moron", "trash"]
    direct = LandmarkKernel(small)(["idiiot", "stup1d", "nothing", "i-d-i-o-t"])
    monkeypatch.setattr(toxicity_ssk, "_DIRECT", 8)
    hashed = LandmarkKernel(small)
    assert hashed.keys is not None
    assert np.array_equal(direct, hashed(["idiiot", "stup1d", "nothing", "i-d-i-o-t"]))


PHRASE = "go back to where you came from".split()


def phrase_texts(rng, n):
    """Every second text has the phrase, some with a word put in; the others have its words apart."""
    other = [f"word{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(other) for _ in range(60)]
        if i % 2:
            phrase = list(PHRASE)
            if rng.random() < 0.3:
                phrase.insert(rng.randint(1, 6), rng.choice(other))
            at = rng.randint(0, 50)
            words[at:at] = phrase
        else:
            for w in PHRASE:
                words.insert(rng.randint(0, len(words)), w)
        for k in range(9, len(words), 10):
            words[k] += rng.choice([".", "", ","])
        out.append(" ".join(words))
    return out


def test_a_phrase_of_ordinary_words(spark):
    rng = random.Random(4)
    texts = phrase_texts(rng, 1000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = {r.doc_id: r for r in toxicity_scores(df, labels).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert len(held) > 150
    caught = [r.predicted for r in held if r.doc_id % 2]
    wrong = [r.predicted for r in held if not r.doc_id % 2]
    assert sum(caught) / len(caught) >= 0.9 and sum(wrong) / len(wrong) < 0.05
    score = {k: np.mean([r.score for r in held if r.doc_id % 2 == k]) for k in (0, 1)}
    assert score[1] > 0.8 and score[0] < 0.2


def test_words_and_phrases_together():
    rng = random.Random(5)
    texts = phrase_texts(rng, 400)
    y = np.arange(400) % 2
    for i in range(1, 400, 4):  # half of the toxic ones by a word alone
        words = [w for w in texts[i].split() if w.strip(".,") not in PHRASE]
        texts[i] = " ".join([*words, rng.choice(["scumbag", "scummbag", "scum-bag", "scumbags"])])
    machine = fit_machine(texts[:300], y[:300])
    predicted = machine.scores(texts[300:]) >= 0.5
    assert (predicted & (y[300:] == 1)).sum() >= 45 and (predicted & (y[300:] == 0)).sum() <= 2


def test_no_phrase_without_missed_texts():
    texts = ["you scumbag now" if i % 2 else "you are fine now" for i in range(200)]
    assert fit_machine(texts, np.arange(200) % 2).phrases is None


def test_sample_of_long_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(i, f"text {i}") for i in range(400)] + [(1, "other")] * 50 + [(2, long), (401, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(402)] + [(1, 1)] * 100 + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = training_sample(docs, labels, "toxic", 10_000, longest=20_000).collect()
    ids = labels.select("doc_id").where("doc_id IS NOT NULL AND doc_id <> 400").distinct()  # 400 has no text
    learnt = {r.doc_id for r in ids.where(~held_out(F.col("doc_id"))).collect()}
    assert {2, 3, 401} & learnt
    assert len(got) == len(learnt) + (3 in learnt)
    again = training_sample(docs.repartition(7), labels.repartition(3), "toxic", 10_000, longest=20_000).collect()
    assert sorted(got) == sorted(again)
    spread = [r.text for r in got if len(r.text) > 1000]
    assert len(spread) >= (401 in learnt)
    assert all(19_000 < len(t) < 22_000 and "w0 " in t and "w499" in t for t in spread)
    few = training_sample(docs, labels, "toxic", 50, balanced=True).collect()
    assert 25 < len(few) < 80


def test_rows_of_an_empty_machine():
    text, rows = PhraseRows([["a", "b", "c"]])(["", "nothing here"])
    assert len(text) == 0 and rows.shape == (0, 1)
