"""Quoted line breaks in files that many tasks read, against a whole-file parse."""

from __future__ import annotations

import csv
import io
import random

import pytest

from textlens import sources
from textlens.sources.quoted import Quotes, numbered_records, quoted_records


def plain_records(text, sep="\t", skip=0):
    """A reader that goes through the text sign by sign."""
    lines = text.split("\n")
    text = "\n".join(lines[skip:])
    out, record, quoted, at_start, i = [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                record, i = record + '""', i + 2
                continue
            quoted = c != '"'
            record += c
            at_start = False
        elif c == "\n":
            out.append(record)
            record, at_start = "", True
        else:
            quoted = c == '"' and at_start
            at_start = c == sep
            record += c
        i += 1
    return [r for r in [*out, record] if r]


def random_file(rng, records):
    fields = ["a", "", "5\" pipe", "é🙂", '"x"', '"two\nlines"', '"tab\there"', '"a ""q"" b"', '"\n\n"', '""', '"end"more', "x\"\"y", '"' + "long\n" * 30 + '"']
    return "\n".join("\t".join(rng.choice(fields) for _ in range(rng.randint(1, 5))) for _ in range(records)) + "\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ends_inside():
    rng, quotes = random.Random(1), Quotes()
    for _ in range(3000):
        line = "".join(rng.choice(['"', '"', "\t", "a", " "]) for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            opened = ('"' if inside else "") + line + "\n"
            # a record is open if the reader takes the next line into it
            assert quotes.ends_inside(line, inside) == (len(plain_records(opened + "z")) == 1 and opened != "\n"), (line, inside)


@pytest.mark.parametrize("seed", range(4))
def test_same_records_from_many_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    texts = {f"f{k}.tsv": random_file(rng, 60) for k in range(2)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text if seed % 2 else text.replace("\n", "\r\n"), newline="")
    found = quoted_records(spark, str(tmp_path), skip=2)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = [r.value for r in numbered_records(found).orderBy("row_id").collect()]
    want = [r for name in sorted(texts) for r in plain_records(texts[name], skip=2)]
    assert got == want
    ids = sorted(r.row_id for r in numbered_records(found).collect())
    assert ids == list(range(len(want)))


def test_corpus_with_line_breaks_and_short_rows(spark, tmp_path, small_splits):
    rng = random.Random(9)
    rows = [[str(i), f"@@{i}", "kw", "us", rng.choice(["one", "two\nlines", 'say "no"', "tab\there"]) + " x" * 30, "1"] for i in range(40)]
    rows[5] = ["5", "@@5"]  # a row with a key and an article alone is a row
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="\n").writerows(rows)
    (tmp_path / "c.tsv").write_text('pre "amble\nb\nc\nd\n' + out.getvalue())
    got = sources.read_corpus_tsv(spark, str(tmp_path / "c.tsv"), multi_line=True).collect()
    want = {r[0]: tuple([*r, None, None, None, None][:6]) for r in rows}
    assert len(got) == 40 and {r[0]: tuple(r) for r in got} == want
    (tmp_path / "u.tsv").write_text("".join(out.getvalue().splitlines(True)))
    numbered = sources.read_unlabelled_tsv(spark, str(tmp_path / "u.tsv"), row_ids=True, multi_line=True).orderBy("row_id").collect()
    assert [(r.row_id, r[1], r[5]) for r in numbered] == [(i, r[0], r[4] if len(r) > 4 else None) for i, r in enumerate(rows)]


def test_split_file_round_trip(spark, tmp_path, small_splits):
    rows = [(str(i), f"@@{i}", "k", "us", f"line {i}\nand, \"more\" {'x' * 50}", "[1, 0]") for i in range(30)]
    split = spark.createDataFrame(rows, "id string, art_id string, keyword string, country string, text string, label string").coalesce(1)
    sources.write_split(split, str(tmp_path / "s"), "csv")
    back = sources.read_split(spark, str(tmp_path / "s"), "csv", row_ids=True).orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in back] == rows
    assert spark.read.text(str(tmp_path / "s")).rdd.getNumPartitions() > 8


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("")
    assert quoted_records(spark, str(tmp_path / "e.tsv")).count() == 0
    (tmp_path / "o.tsv").write_text('a\t"never closed\nb\n')
    assert [r.value for r in quoted_records(spark, str(tmp_path / "o.tsv")).collect()] == ['a\t"never closed\nb']
