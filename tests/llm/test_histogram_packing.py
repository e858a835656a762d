"""Best-fit packing by the histogram: the plan against plain best fit, ids against the tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from textlens.llm import histogram_packing as packing
from textlens.llm import token_ids
from textlens.llm.queries import op11_best_fit, tokenizer_path
from tests.llm.conftest import SMALL

PATH = tokenizer_path("byte_bpe_50k.json")
PIECES = ["", " ", "  ", "a", "the", "ÀÉ", "ſ", "é", "“", "’s", "'s", "'re", "\n", "\n\n", "\t", "\r\n", "\x85", "\xa0", "　",
          "!", "...", "1", "23", "中", "é", "​", "🙂", "<|endoftext|>", "<|endof", "x y", "\x00"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def best_fit_decreasing(lengths, size):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(size - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 8, 16, 64, 1024])
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, size + 1), rng.randint(1, min(size, 60)))}
    filled, ranks = defaultdict(list), defaultdict(int)
    for length, low, high, sequence, each, at in packing.plan(histogram, size):
        assert ranks[length] == low
        ranks[length] = high
        for nth in range(high - low):
            filled[sequence + nth // each].append((at + nth % each * length, length))
    assert ranks == histogram
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    lengths = [n for n, count in histogram.items() for _ in range(count)]
    assert sorted(filled) == list(range(best_fit_decreasing(lengths, size)))


def test_plan_is_small_whatever_the_counts():
    rng = random.Random(1)
    for top in (3, 10**9):
        assert len(packing.plan({n: rng.randint(1, top) for n in range(1, 1025)})) <= 10 * 3 * 1024


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    encoder = token_ids.ByteLevelIds(PATH)
    for s in range(0, len(texts), 1000):
        part = texts[s : s + 1000]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(part)] == [ids_of(tokenizer, t)[:-1] for t in part]


def test_words_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 3)
    encoder = token_ids.ByteLevelIds(PATH)
    texts = ["one two three four", "two five " + "x" * 100, "one two"]
    for text in texts * 2:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(tokenizer, text)[:-1]
    assert "x" * 100 not in encoder.known


def test_plain_texts_do_not_go_through_the_tokenizer(tokenizer, monkeypatch):
    encoder, asked = token_ids.ByteLevelIds(PATH), []
    real = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or real(texts))
    texts = ["One, two:  dr\u00f6lf!\n\n 12", "one\ttwo", "One <|endoftext|> two", " Qu\u00e9's\u20ac... "]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [ids_of(tokenizer, t)[:-1] for t in texts]
    assert asked == texts[1:3]


def check(rows, texts, tokenizer, size):
    """`rows` are a right packing of (id, text) pairs; returns the number of sequences."""
    wanted = sorted((k is not None, k or 0, len(ids_of(tokenizer, t)), zlib.crc32(np.array(ids_of(tokenizer, t), "<u4").tobytes())) for k, t in texts)
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], bytes(r["ids"])))
    found = []
    for key, parts in pieces.items():
        open_docs = []
        for piece, start, ids in sorted(parts):  # rows that share an id: match by start
            if piece == 0:
                assert start == 0
                open_docs.append([ids])
            else:
                assert len(ids) == 4 * size
                doc = next(d for d in open_docs if sum(map(len, d)) == 4 * start and len(d) == piece)
                doc.append(ids)
        found += [(key is not None, key or 0, sum(map(len, d)) // 4, zlib.crc32(b"".join(d))) for d in open_docs]
    assert sorted(found) == wanted
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(filled)


def test_awkward_rows(spark, docs, tokenizer):
    rng = random.Random(4)
    texts = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (3, "other"), (None, "no id"), (None, None)]
    texts += [(10 + i, " ".join(rng.choice(["ab", "the", "zebra"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    texts.append((500, "word " * 30_000))
    table = docs([t for _, t in texts], [k for k, _ in texts])
    for name in ("id", "length", "rank", "part", "place", "low"):  # names that the operator uses inside
        table = table.withColumn(name, table["n_chars"])
    rows = packing.pack_best_fit(table.repartition(5), PATH, size=64, with_ids=True).collect()
    assert set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"}
    n = check(rows, texts, tokenizer, 64)
    lengths = [m for _, t in texts for m in [len(ids_of(tokenizer, t))] for m in [m % 64 or 64] + [64] * ((m - 1) // 64)]
    assert n == best_fit_decreasing(lengths, 64)


def test_empty_table(docs):
    assert packing.pack_best_fit(docs([]), PATH).collect() == []


def test_query_packs_the_whole_table(spark, small, tokenizer):
    rows = op11_best_fit(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in small("documents").select("doc_id", "text").collect()}
    lengths = {k: len(ids_of(tokenizer, t)) for k, t in texts.items()}
    assert len(rows) == sum(-(-n // 1024) for n in lengths.values())
    used = defaultdict(int)
    for r in rows:
        n = lengths[r["doc_id"]]
        first = (n - 1) % 1024 + 1
        assert (r["start"], r["length"]) == ((0, first) if r["piece"] == 0 else (first + 1024 * (r["piece"] - 1), 1024))
        ids = ids_of(tokenizer, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        used[r["sequence_id"]] += r["length"]
    pieces = [m for n in lengths.values() for m in [(n - 1) % 1024 + 1] + [1024] * ((n - 1) // 1024)]
    assert len(used) == best_fit_decreasing(pieces, 1024) and max(used.values()) <= 1024
