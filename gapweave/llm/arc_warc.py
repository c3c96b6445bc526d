"""Converter from legacy ARC archives to WARC, with a writer and a reader of either.

ARC. A file begins with a ``filedesc://`` record whose body names the version and its
header fields: version 1 has URL, IP address, date, content type and length; version 2 adds
result code, checksum, location, offset and file name. Each header line declares the length
of the bytes that follow, so records are found by length, never by searching for text.
The fields are split from the right: an old URL may hold blanks.

WARC. Per ARC record the converter synthesises a record id (a UUID of the archive's name,
offset and digest, hence the same when the same archive is converted again), the date, the type and the digests. Of
records with equal payloads of at least ``least`` bytes the one with the largest page number
is the response, the others are revisits of it without payload.

Archives are written by Spark's text sink, which puts the record separator of the format
after each value, and gzips a file as one member; they are read by Spark's binary file
source, so both work in any store that Spark reaches. A file is the unit of a task, as
gzipped archives can't be split; the writer keeps a file to ``file_bytes`` of payload or one
longer record. Payloads are shuffled once, to meet the choice of responses by digest; that
join has no aggregate under it on either side, so Spark can split a digest that a third of
all records share.

Defined results: a null html is an empty payload; a null url is written as ``about:blank``;
blanks and control characters of a url are percent-coded; repeated rows are records of
their own, equal in all but their place, and of those with the largest page number the one
with the largest record id is the response; pages without a number come after all others; an
empty table gives empty archives; further columns are not written. A page's payload is held
whole by its task. A record cut short by the end of its file is an error.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.storage import materialize, work_folder

FILE_BYTES = 32 << 20
EPOCH = dt.datetime(2000, 1, 1)
#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_END, WARC_END = "\n", "\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    archive: str
    offset: int
    body: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_head(version: int, name: str) -> str:
    """The ``filedesc`` record, without its end."""
    body = f"{version} 0 gapweave\n{ARC_FIELDS[version]}\n"
    more = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain{more} {len(body)}\n{body}"


def arc_record(version: int, name: str, offset: int, url: str, date: str, body: bytes) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{more} {len(body)}\n".encode() + body


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file after its ``filedesc`` record."""
    at, fields, name = 0, 5, ""
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):  # ends of records
            at += 1
            continue
        stop = raw.find(b"\n", at)
        head = raw[at : stop if stop >= 0 else len(raw)].decode("utf-8", "replace").rstrip("\r")
        offset, parts = at, head.rsplit(" ", fields - 1)
        if head.startswith("filedesc://"):
            parts = head.split(" ")
        if stop < 0 or len(parts) < 5 or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {head[:80]!r}")
        body = raw[stop + 1 : stop + 1 + int(parts[-1])]
        if len(body) < int(parts[-1]):
            raise ValueError(f"the ARC record at byte {at} is cut short")
        at = stop + 1 + len(body)
        if head.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            fields, name = len(ARC_FIELDS[version].split(" ")), parts[0][len("filedesc://") :]
            continue
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], name, offset, body)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, lower-cased, and block of each WARC record."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        lines = raw[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        block = raw[end + 4 : end + 4 + int(head["content-length"])]
        if len(block) < int(head["content-length"]):
            raise ValueError(f"the WARC record at byte {at} is cut short")
        at = end + 4 + len(block)
        yield head, block


def _unzipped(raw: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        tool = zlib.decompressobj(31)
        out.append(tool.decompress(raw))
        if not tool.eof:
            raise ValueError("the gzip file is cut short")
        raw = tool.unused_data
    return b"".join(out) + raw


def _save(lines: DataFrame, path: str, end: str) -> None:
    lines.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arcs(pages: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Pages ``(page_id, url, html)`` as ARC files, of versions 1 and 2 in turn.

    The page's number goes along as a field of the HTTP header.
    """
    size = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    parts = max(1, -(-((size[0] or 0) + 300 * size[1]) // file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}.arc"
        head = arc_head(version, name)
        at = len(head) + 1
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                date = EPOCH + dt.timedelta(seconds=abs(page or 0) % (1 << 31))
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
                number = f"X-Page-Id: {page}\r\n" if page is not None else ""
                block = (
                    f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}"
                    f"Content-Length: {len(payload)}\r\n\r\n"
                ).encode() + payload
                record = arc_record(version, name, at, url, f"{date:%Y%m%d%H%M%S}", block)
                at += len(record) + 1
                out.append(record.decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows = pages.select("page_id", "url", "html").repartition(parts, F.xxhash64("page_id", "url"))
    _save(rows.mapInArrow(run, "value string"), path, ARC_END)


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ARC files in a folder, with what the WARC records are made of."""
    schema = (
        "page_id long, record_id string, url string, date string, ip string, archive string,"
        " payload_digest string, payload_bytes long, http string, payload string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(",")]
        kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for r in read_arc(_unzipped(raw.as_py())):
                    head, payload = http_parts(r.body)
                    sha, page = digest(payload), header_value(head, "X-Page-Id")
                    name = uuid.uuid5(NAMESPACE, f"{r.archive}/{r.offset}/{r.url}/{sha}")
                    when = dt.datetime.strptime(r.date, "%Y%m%d%H%M%S")
                    rows.append(
                        (
                            int(page) if page else None, f"<urn:uuid:{name}>", r.url, f"{when:%Y-%m-%dT%H:%M:%SZ}", r.ip,
                            r.archive, sha, len(payload), head.decode(), payload.decode(),
                        )
                    )
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def arc_to_warc(spark: SparkSession, arcs: str, warcs: str, *, least: int = 0) -> None:
    """Convert all ARC files of a folder to WARC files in another."""
    records = arc_records(spark, arcs)
    whole = F.col("payload_bytes") >= least
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), "record_id", "url", "date"))
    # the choice is stored, so that both sides of the join are plain tables
    chosen = materialize(
        records.where(whole).groupBy("payload_digest").agg(best.alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("payload_digest", "to")
    )
    joined = records.join(chosen, "payload_digest", "left")
    again = F.col("to").isNotNull() & whole & (F.col("to.record_id") != F.col("record_id"))
    end = "\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(end))
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    revisit = F.when(
        again,
        F.concat(
            line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            line("WARC-Refers-To", F.col("to.record_id")),
            line("WARC-Refers-To-Target-URI", F.col("to.url")),
            line("WARC-Refers-To-Date", F.col("to.date")),
        ),
    ).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1" + end),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        revisit,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit(end),
        F.col("_block"),
    )
    _save(joined.withColumn("_block", block).select(record.alias("value")), warcs, WARC_END)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files in a folder; payload digests of responses are verified."""
    schema = (
        "page_id long, record_id string, record_type string, refers_to_id string, url string, date string,"
        " payload_digest string, payload_bytes long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(",")]
        kinds = [pa.int64(), *[pa.string()] * 6, pa.int64()]
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for head, block in read_warc(_unzipped(raw.as_py())):
                    http, payload = http_parts(block)
                    sha = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        if digest(payload) != sha:
                            raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
                        size = len(payload)
                    else:
                        size = int(header_value(http, "Content-Length") or 0)
                    page = header_value(http, "X-Page-Id")
                    rows.append(
                        (
                            int(page) if page else None, head["warc-record-id"], head["warc-type"],
                            head.get("warc-refers-to"), head["warc-target-uri"], head["warc-date"], sha, size,
                        )
                    )
                columns = list(zip(*rows)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def convert_pages(pages: DataFrame, *, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC files, those to WARC files, and a row per record read back from them."""
    spark = pages.sparkSession
    folder = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    write_arcs(pages, f"{folder}/arc", file_bytes=file_bytes)
    arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", least=least)
    back = materialize(warc_records(spark, f"{folder}/warc"))
    responses = back.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    return back.join(responses, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"
    )
