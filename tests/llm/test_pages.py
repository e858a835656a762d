from __future__ import annotations

import glob
import gzip
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textlens.llm import archives
from textlens.llm.archives import arc_record, archive_round_trip, parse_arc, read_arc, version_block, write_arc
from textlens.llm.common import scratch
from textlens.llm.queries import URL_RULES
from textlens.llm.url_rules import judge_urls, match_rules, mine_rules, url_tokens

URLS = [
    None, "", "no scheme", "http://EXAMPLE.net/en/1?x=1#y", "https://a.b.net", "http://net/", "http://xnet/", "ftp://example.com/de/",
    "http://www.example.com/de", "http://org/fr/x", "http://é.org/FR/x", "http://h?q://z/", "a://b://c/d", "http://a.net\n/x", "http://a.org/fr/a\nb?c",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[at:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), tail[:end]


def test_parts_and_list(spark):
    df = spark.createDataFrame([(i, u, "t") for i, u in enumerate(URLS)] + [(None, URLS[3], "t")] * 2, "page_id long, url string, tokens string")
    got = judge_urls(df, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[3 if r.page_id is None else r.page_id]
        host, path = parse(url)
        assert (r.host, r.path) == (host, path), url
        fits = [(len(k), k, v) for k, v in URL_RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_mined_rules_equal_brute_force(spark):
    rows = [(sorted({f"a{i % 3}", f"b{i % 4}", f"c{i % 2}"}), "block" if i % 3 == 0 and i % 2 else "allow") for i in range(48)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    want = {}
    for size in (1, 2, 3):
        for items in {c for t, _ in rows for c in combinations(t, size)}:
            hold = [l for t, l in rows if set(items) <= set(t)]
            for label in set(hold):
                if hold.count(label) / 48 >= 0.05 and hold.count(label) / len(hold) >= 0.9:
                    want[items, label] = hold.count(label) / len(hold)
    want = {k: v for k, v in want.items() if not any(want.get((tuple(x for x in k[0] if x != i), k[1]), 0) >= v for i in k[0])}
    rules = mine_rules(df, 0.05, 0.9)
    assert {(tuple(r.antecedent), r.verdict): r.confidence for r in rules.collect()} == pytest.approx(want)
    for r in match_rules(df.select("tokens").distinct(), rules).collect():
        fits = [(c, k[1]) for k, c in want.items() if set(k[0]) <= set(r.tokens)]
        assert r.found.confidence == pytest.approx(max(fits)[0])


def test_tokens_and_empty_table(spark):
    assert spark.createDataFrame([("http://a.b.org/x/y/z9.html?k=1&j=2#f",)], "u string").select(url_tokens(F.col("u"))).first()[0] == [
        "between:y", "depth:3", "domain:b.org", "extension:html", "folder:x", "fragment:f", "keys:j&k", "last:z#.html", "scheme:http", "sub:a", "top:org",
    ]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_records_of_either_version(version):
    data = version_block(version, "f") + b"\n" + arc_record(version, "http://a b\n", 5, b"x\n\ny", "f") + b"\n" + arc_record(version, None, None, b"", "f")
    (head, body, v, _), (bare, empty, _, _) = parse_arc(data)
    assert v == version and head["URL"] == "http://a%20b%0A" and int(head["Archive-length"]) == len(body)
    assert body.endswith(b"\r\n\r\nx\n\ny") and b"X-Page-Id: 5\r\n" in body
    assert bare["URL"] == "-" and b"X-Page-Id" not in empty
    with pytest.raises(ValueError):
        list(parse_arc(data + b"\nhttp://a 0.0.0.0 20240101000000 text/html 9999\nshort"))
    with pytest.raises(ValueError):
        list(parse_arc(data + b"\nhttp://a 20240101000000 3\nabc"))


def test_round_trip(spark):
    long = "é" * 600
    tricky = "WARC/1.1\r\n\r\n" + long + "\r\n\r\n"
    rows = [(1, "http://a b", long), (2, None, long), (None, "u", long), (3, "u\n", tricky), (3, "u", tricky), (4, "", None), (5, "y", ""), (6, "y", "short"), (7, "y", "short")]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(archive_round_trip(df).collect(), key=str)
    of = lambda i: [(r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id == i]
    assert of(1) == of(None) == [(1200, "revisit", 2)] and of(2) == [(1200, "response", None)]
    assert sorted(of(3), key=str) == [(1216, "response", None), (1216, "revisit", 3)]
    assert of(4) == of(5) == [(0, "response", None)] and of(6) == of(7) == [(5, "response", None)]
    path = scratch(spark, "arc-test")
    write_arc(df.repartition(2), path)
    back = read_arc(spark, path)
    assert sorted(bytes(r.payload).decode() for r in back.collect()) == sorted(h or "" for _, _, h in rows)
    assert {r.arc_version for r in back.collect()} == {1, 2}
    assert archive_round_trip(df.limit(0)).count() == 0


def test_warc_files_of_pages_that_compress_well(spark, tmp_path, monkeypatch):
    """Spark reads many small ARC files in one task; the WARC files still have a bound."""
    monkeypatch.setattr(archives, "FILE_BYTES", 300_000)
    rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>" + "same words " * 2_000) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(30)
    archives.write_arc(pages, str(tmp_path / "arc"))
    arc = archives.read_arc(spark, str(tmp_path / "arc")).coalesce(1)
    archives.convert_to_warc(arc, str(tmp_path / "warc"))
    sizes = [len(gzip.open(f).read()) for f in glob.glob(str(tmp_path / "warc/*.gz"))]
    assert len(sizes) >= 8 and max(sizes) < 2 * 300_000 and sum(sizes) > 120 * 22_000
    back = archives.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted(r.page_id for r in back) == list(range(120)) and {r.record_type for r in back} == {"response"}
