r"""Legacy archive converter: ARC records to WARC records.

An ARC file starts with a version block, whose second line tells the version of the header lines after it: version 1 has
URL, IP address, date, type and length; version 2 also a status, a checksum, a location, an offset and a file name. The
reader goes by declared lengths alone, never by what a payload looks like. Each record becomes a WARC record with the
same target, time and payload; its identifier is a name-based UUID of what it holds, its digest the SHA-1 of the payload.
Of records with equal payloads of 1,000 bytes or more, all but one become revisits.

Archives are written by Spark's text writer, a record to a line that ends in the two line breaks that end a WARC record,
so they land in any store Spark writes to, whole files at a time, however often a task is tried.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Header fields by ARC version (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads below this are never revisits.
REVISIT_BYTES = 1000
#: Bytes of payload that one archive file should hold.
FILE_BYTES = 8_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


# --- ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(FIELD_TITLES[f] for f in ARC_FIELDS[version])}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name}
    return arc_record(version, fields, body)


FIELD_TITLES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}


def arc_record(version: int, fields: dict[str, str], payload: bytes) -> bytes:
    """A header line, the payload, a line break. Blanks and line breaks within a field, which the format cannot hold, are percent-encoded."""
    line = [re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), fields[f]) or "-" if f != "length" else str(len(payload)) for f in ARC_FIELDS[version]]
    return " ".join(line).encode() + b"\n" + payload + b"\n"


class ArcError(ValueError):
    pass


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record after the version block."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no header line ends after {at}")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not version and not parts[0].startswith("filedesc://"):
            raise ArcError("no version block")
        names = ARC_FIELDS[version] if version else ARC_FIELDS[1] if len(parts) == len(ARC_FIELDS[1]) else ARC_FIELDS[2]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArcError(f"the header line at {at} is none of version {version or '1 or 2'}")
        length = int(parts[-1])
        payload = data[end + 1 : end + 1 + length]
        if len(payload) < length:
            raise ArcError(f"the record at {at} is cut off")
        at = end + 1 + length
        if not version:
            version = int(payload.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ArcError(f"unknown version {version}")
        else:
            yield dict(zip(names, parts, strict=True)), payload
        while data[at : at + 1] in (b"\n", b"\r"):  # records are apart by a line break, or more
            at += 1


# --- WARC


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a beginning of it, as ISO 8601; what is missing is the first of its kind, and a date that is none the epoch."""
    digits = arc_date if arc_date.isdigit() and 4 <= len(arc_date) <= 14 else "19700101000000"
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def warc_header(fields: dict[str, str | None]) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return BREAK.join(lines) + BREAK * 2


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split(BREAK)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        n = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has no end")
        at = end + 8 + n


# --- over tables

def arc_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id and arc, a one-record ARC file, for each row of pages: version 1 for even identifiers, 2 for odd ones. Null url or payload is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, payloads = (c.to_pylist() for c in batch.columns)
            arcs = []
            for page, url, payload in zip(ids, urls, payloads, strict=True):
                version = 1 + (page or 0) % 2
                date = f"2024{1 + (page or 0) % 12:02d}01000000"
                own = {"url": url or "", "ip": "0.0.0.0", "date": date, "type": "text/html", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "pages.arc"}
                arcs.append(arc_version_block(version, "pages.arc", date) + arc_record(version, own, payload or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arcs, pa.binary())], names=["page_id", "arc"])

    picked = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{payload_col}`").cast("string").cast("binary"))
    return picked.mapInArrow(run, "page_id long, arc binary")


def convert(arcs: DataFrame) -> DataFrame:
    """A row for each record of the ARC files in `arcs` (page_id, arc): page_id, target, date, kind, payload, bytes, digest and warc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (head, payload) in enumerate(read_arc(data)):
                    digest = hashlib.sha1(payload).hexdigest()
                    date = warc_date(head["date"])
                    out.append((page, head["url"], date, head["type"], payload, len(payload), digest, record_id(str(page), str(k), head["url"], date, digest)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    names = ["page_id", "target", "date", "kind", "payload", "bytes", "digest", "warc_id"]
    return arcs.mapInArrow(run, "page_id long, target string, date string, kind string, payload binary, bytes long, digest string, warc_id string")


def with_revisits(records: DataFrame) -> DataFrame:
    """records with `to`, a struct of the response's page_id, warc_id, target and date where the record is a revisit.

    Of records with equal payloads of REVISIT_BYTES or more, that with the largest page_id (null is least), then warc_id, is the response.
    Only what names a record is aggregated, payloads stay where they are.
    """
    names = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("k"), "page_id", "warc_id", "target", "date")
    firsts = records.filter(F.col("bytes") >= REVISIT_BYTES).groupBy(F.col("digest").alias("of"), F.col("bytes").alias("n"))
    firsts = firsts.agg(F.max(names).alias("to"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = materialize(firsts, "responses")  # so that its size is known, and payloads are shuffled for it only where it is large
    met = records.join(firsts, (F.col("digest") == F.col("of")) & (F.col("bytes") == F.col("n")), "left")
    return met.withColumn("to", F.when(F.col("to.warc_id") != F.col("warc_id"), F.col("to"))).drop("of", "n", "copies")


def warc_text(records: DataFrame) -> DataFrame:
    """value: each record as WARC text, without the two line breaks that end it. A revisit has no block and tells the size of what it stands for."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK))).otherwise("")
    again = F.col("to").isNotNull()
    head = [
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("warc_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.col("to.warc_id")),
        line("WARC-Refers-To-Target-URI", F.col("to.target")),
        line("WARC-Refers-To-Date", F.col("to.date")),
        line("X-Payload-Length", F.col("bytes")),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("to.page_id")),
        line("Content-Type", F.col("kind")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes"))),
        F.lit(BREAK),
    ]
    return records.select(F.concat(*head, F.when(again, "").otherwise(F.col("payload").cast("string"))).alias("value"))


def write_warc(records: DataFrame, path: str, total_bytes: int) -> None:
    """Write records as WARC files of about FILE_BYTES under `path`, dealt at random so that files are of a size."""
    files = max(1, -(-total_bytes // FILE_BYTES))
    warc_text(records).repartition(files).write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the WARC files under `path`. Responses' digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for data in batch.column(0):
                out = []
                for head, block in read_warc(gzip.decompress(data.as_buffer())):
                    digest, n, kind = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), head["warc-type"]
                    if kind == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, n):
                        raise ValueError(f"record {head['warc-record-id']} is not what its header tells")
                    of = lambda name, head=head: int(head[name]) if name in head else None
                    out.append((of("x-page-id"), n, digest, kind, of("x-refers-to-page-id")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # A file is one row, of about FILE_BYTES before compression.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Convert pages (page_id, url, html), as ARC records, to WARC files under `path` (a new shared folder where None), and read those back.

    A row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload,
    null url a target of "-". Rows that repeat whole are one record, written as often. Extra columns are ignored; no rows
    give no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    records = with_revisits(convert(arc_of_pages(pages)))
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html") + 600), F.lit(0))).first()[0]
    write_warc(records, path, total)
    return read_warcs(spark, path)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""
