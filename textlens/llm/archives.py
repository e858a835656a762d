"""Legacy web archives (ARC) and their conversion to WARC.

ARC files start with a version block that names the header fields of the records; each
record is one header line and as many bytes as the line declares. The converter reads both
versions of the format and makes WARC records with the same content: identifiers from the
place of the record, timestamps, types, and digests of the payload. Files are written by
Spark's text writer and read whole, one file a row, so any storage that Spark reaches will
do; files are kept small by their number.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import scratch, store

#: Payload bytes aimed at in one file.
FILE_BYTES = 64_000_000
DATE = "20240101000000"
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ARC_RECORD = "url string, date string, mime string, arc_version int, http binary, payload binary, record_id string"
_ID = re.compile(rb"(?im)^x-page-id: *(-?\d+)\r?$")


def arc_url(url: str | None) -> str:
    """A url for a header line: fields are split at blanks, so these are escaped."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 textlens\n{' '.join(FIELDS[version])}\n".encode()
    values = ["filedesc://" + name, "0.0.0.0", DATE, "text/plain"]
    if version == 2:
        values += ["200", "-", "-", "0", name]
    return " ".join([*values, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes, name: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += b"X-Page-Id: %d\r\n" % page_id
    body = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    values = [arc_url(url), "0.0.0.0", DATE, "text/html"]
    if version == 2:
        values += ["200", "-", "-", "0", name]
    return " ".join([*values, str(len(body))]).encode("utf-8", "surrogatepass") + b"\n" + body


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, content, version, offset) of each record; the version block is read, not given.

    Header values are matched to the names that the version block lists. A line that does not
    fit them, or a length that the file cannot hold, is an error: silence would lose records.
    """
    fields, version, at = FIELDS[1], 1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        start, length = end + 1, int(values[-1])
        if length < 0 or start + length > len(data):
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(data) - start} are left")
        content = data[start : start + length]
        if values[0].startswith("filedesc://"):
            first, names = content.decode().split("\n")[:2]
            version, fields = int(first.split(" ")[0]), tuple(names.split(" "))
        elif len(values) != len(fields):
            raise ValueError(f"record at byte {at}: {len(values)} fields, {len(fields)} are named")
        else:
            yield dict(zip(fields, values)), content, version, at
        at = start + length


def _arc_files(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, file = 1 + part % 2, f"{name}-{part:06d}.arc"
        yield pa.RecordBatch.from_arrays([pa.array([version_block(version, file)], pa.binary())], ["record"])
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                rows = batch.slice(s, 200).to_pydict()
                records = [arc_record(version, u, i, p or b"", file) for u, i, p in zip(rows["url"], rows["page_id"], rows["payload"])]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    return run


def _write_text(rows: DataFrame, path: str, separator: str, per_file: int = 0) -> None:
    """Byte strings, each followed by the separator; compressed, as such archives are. With
    `per_file` a task begins another file after so many."""
    (
        rows.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", per_file)
        .option("zlib.compress.level", "BEST_SPEED").text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
        .select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    )


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """An ARC file for each partition, every other one of version 2, of at most about 64 MB of payload each.

    A null html is an empty payload, a null url is written as `-`, a null id is left out.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).cast("binary").alias("payload"),
    )
    bytes_ = rows.agg(F.sum(F.length("payload"))).first()[0] or 0
    files = max(1, -(-bytes_ // FILE_BYTES))
    if rows.rdd.getNumPartitions() < files:
        rows = rows.repartition(files)
    _write_text(rows.mapInArrow(_arc_files("pages"), "record binary"), path, "\n")


def _inflated(content: bytes) -> bytes:
    out, rest = [], content
    while rest:
        d = zlib.decompressobj(31)
        out.append(d.decompress(rest))
        rest = d.unused_data
    return b"".join(out)


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in ARC_RECORD.split(", ")]
    for batch in batches:
        for file, content in zip(batch["file"].to_pylist(), batch["content"]):
            rows: list[tuple] = []
            for head, body, version, offset in parse_arc(_inflated(content.as_py())):
                http, gap, payload = body.partition(b"\r\n\r\n")
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{offset}")
                rows.append((head["URL"], head["Archive-date"], head["Content-type"], version, http + gap, payload, f"<urn:uuid:{record}>"))
                if len(rows) == 200:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"arc_version": pa.int32(), "http": pa.binary(), "payload": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files of either version: url, date, mime, HTTP header, payload, and the
    identifier that the converted record gets, which follows from the file and the offset."""
    return _files(spark, path).mapInArrow(_arc_rows, ARC_RECORD)


def warc_columns(arc: DataFrame) -> DataFrame:
    """Adds `digest` (SHA-1 of the payload, hex), `payload_bytes` and `warc_date`."""
    return arc.withColumns({
        "digest": F.sha1("payload"),
        "payload_bytes": F.length("payload").cast("long"),
        "warc_date": F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*", "$1-$2-$3T$4:$5:$6Z"),
    })


def page_id_of(http) -> F.Column:
    text = F.decode(http, "ISO-8859-1")
    return F.regexp_extract(text, r"(?im)^x-page-id: *(-?\d+)\r?$", 1).try_cast("long")


def payload_groups(arc: DataFrame, least_bytes: int) -> DataFrame:
    """`digest, original, original_page, n, bytes`: each payload of at least `least_bytes`, the record
    that stays whole, how many records have it and their length; all others are one row without digest.

    The record is the one with the largest page id; a null id comes last, and equal ids go by the
    record's identifier. Digests are aggregated before they are shuffled.
    """
    large = F.col("payload_bytes") >= least_bytes
    keys = warc_columns(arc).select(
        F.when(large, F.col("digest")).alias("digest"),
        F.when(large, F.struct(page_id_of(F.col("http")).alias("page_id"), "record_id")).alias("key"),
        (F.length("http") + F.length("payload")).alias("length"),
    )
    found = keys.groupBy("digest").agg(F.max("key").alias("key"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return found.select("digest", F.col("key.record_id").alias("original"), F.col("key.page_id").alias("original_page"), "n", "bytes")


def convert_to_warc(arc: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Write WARC files: a response for each record, or a revisit where the same payload of at
    least `least_bytes` is kept in another. Revisits keep the HTTP header, not the payload.

    The table of repeated payloads is stored, so that its true size decides whether it is
    broadcast; if not, a payload that very many records share is split by adaptive execution.
    A file holds as many records as make up `FILE_BYTES` on average over all records, however
    well they compress: Spark gives a task many files that compress well.
    """
    groups = store(payload_groups(arc, least_bytes), "warc-payloads")
    again = groups.where(F.col("digest").isNotNull() & (F.col("n") > 1))
    repeated = store(again.select("digest", "original", "original_page"), "warc-originals")
    seen = groups.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    per_file = max(1, FILE_BYTES * (seen["n"] or 1) // max(1, seen["bytes"] or 1))
    rows = (
        warc_columns(arc).join(repeated, "digest", "left")
        .withColumn("revisit", F.coalesce((F.col("payload_bytes") >= least_bytes) & (F.col("original") != F.col("record_id")), F.lit(False)))
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            F.col("revisit"),
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.col("original")),
                F.coalesce(line("WARC-Refers-To-Page", F.col("original_page").cast("string")), F.lit("")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    _write_text(rows.select(F.concat(F.encode(head, "UTF-8"), block).alias("record")), path, "\r\n\r\n", per_file)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, length = end + 4, int(head["Content-Length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end after {length} bytes")
        yield head, data[start : start + length]
        at = start + length + 4


WARC_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_record string, refers_to string, record_id string, target string"


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in WARC_RECORD.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in parse_warc(_inflated(content.as_py())):
                http, _, payload = block.partition(b"\r\n\r\n")
                found = _ID.search(http)
                size, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    size, again = len(payload), hashlib.sha1(payload).hexdigest()
                    if again != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                rows.append((int(found[1]) if found else None, size, digest, head["WARC-Type"], head.get("WARC-Refers-To"), head.get("WARC-Refers-To-Page"), head["WARC-Record-ID"], head["WARC-Target-URI"]))
            if rows:
                yield _batch(rows, names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files; digests of whole payloads are checked."""
    return _files(spark, path).select("content").mapInArrow(_warc_rows, WARC_RECORD)


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000, **columns: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the records read back from these.

    `page_id, payload_bytes, payload_digest, record_type, refers_to`. Null html and empty
    html are empty payloads; a null url and a null id survive; rows that repeat an id are
    records of their own, of which one is whole. Very long pages make a longer file. An
    empty table gives files without records. Other columns are not read.
    """
    spark = pages.sparkSession
    arc_path, warc_path = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc_path, **columns)
    convert_to_warc(read_arc(spark, arc_path), warc_path, least_bytes)
    return read_warc(spark, warc_path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
