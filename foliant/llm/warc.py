"""WARC archives (operator 13): written once for each payload, and read back by a salvage reader.

Writing: pages are grouped by their payload (SHA-256; a payload that very many pages share
collapses before the shuffle). The page with the largest page_id of a group becomes a
``response`` record that holds the payload, all others ``revisit`` records that refer to it.
Tasks pack records into archives of some ``ARCHIVE_BYTES`` each, gzip members of their own or
plain, and Spark's file writer commits them, so that a lost task leaves no half archive.

Reading: every archive is read by one task, record by record. A record counts if all its checks
hold: gzip's checksum, version line, header lines, length, record end, block and payload
digests. After a failed check the reader searches for the next place where a valid gzip member
or a version line with a valid record begins, goes on from there, and reports the bytes in
between as a quarantined gap with the first reason. A valid record that stands inside a
damaged one cannot be told from a record of its own; what follows a gap is marked ``after_gap``.

Defined cases: a null html is an empty payload, which is a payload like any other; page_ids may
repeat: of rows with equal page_id, url and payload one is the response; a null page_id is less
than any other; a null url writes no target; control characters, spaces and non-ASCII letters of
urls are percent-encoded in headers; an empty table gives no archive and no record; very long
texts make an archive of their own; an archive must fit a row of Spark's binary reader (2 GB).
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.packed import give_back
from foliant.session import settle, shared_folder, ship

#: Bytes of an archive, and of the rows that it is written from (a larger record is a row of its own).
ARCHIVE_BYTES, ROW_BYTES = 16 << 20, 1 << 20
#: A payload of more than this part of all pages is hot: there can be no more than its inverse of them.
HOT_PART = 1e-3
#: What a gzip member may hold, unpacked.
MEMBER_BYTES = 1 << 30
#: Fixed values of the format.
END, VERSION, MEMBER = b"\r\n\r\n", b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NO_MEMBER = zlib.compress(b"", 9, 31)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, sha1_hex: str, number: int, target: int | None, date: str) -> bytes:
    """A whole record without its end; ``payload`` is None for a revisit, ``target`` the page it refers to."""
    digest = base32(sha1_hex)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http if payload is None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}:{digest}:{number}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~\"<>\\^`{|}"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:x-page:{target}:{digest}:0>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "WARC-Block-Digest: sha1:" + base32(hashlib.sha1(body).hexdigest())]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body


def records(pages: DataFrame) -> DataFrame:
    """What is to be written: page_id, url, html (null for revisits), n_bytes, sha1, number, target."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("key"))
    payloads = rows.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("best"), F.first("html").alias("html"), F.count("*").alias("pages"))
    payloads = settle(payloads.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long")), "payloads")
    whole = payloads.select(F.col("best.page_id").alias("page_id"), F.col("best.url").alias("url"), "html", "n_bytes", "sha1", F.lit(0).cast("long").alias("number"), F.lit(None).cast("long").alias("target"))
    # Pages beside the response: their rows are narrow, and those of hot payloads meet them by broadcast.
    limit = (payloads.agg(F.sum("pages")).first()[0] or 0) * HOT_PART
    shared = payloads.where("pages > 1").select("key", "best", "n_bytes", "sha1", "pages")
    hot, cold = shared.where(F.col("pages") > limit).drop("pages"), shared.where(F.col("pages") <= limit).drop("pages")
    same = rows.groupBy("key", "page_id", "url").agg(F.count("*").alias("n"))
    met = same.join(F.broadcast(hot), "key").unionByName(same.join(cold, "key"))
    is_best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    # Rows that repeat are numbered in two steps, so that no array is long.
    step = 1 << 16
    last = F.col("n") - F.when(is_best, 1).otherwise(0)
    again = met.withColumn("last", last).where("last > 0").withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"), F.lit(step).cast("long"))))
    again = again.withColumn("number", F.explode(F.sequence("from", F.least("last", F.col("from") + (step - 1)))))
    revisits = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "n_bytes", "sha1", "number", F.col("best.page_id").alias("target"))
    return whole.unionByName(revisits)


def write(pages: DataFrame, folder: str, compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record for every row of ``pages`` into archives in ``folder``."""
    ship(pages.sparkSession)
    row_bytes = min(ROW_BYTES, archive_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, size = [], 0
        join = b"" if compressed else END

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([join.join(held)], pa.binary())], names=["part"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "n_bytes", "sha1", "number", "target")]
            for row in zip(*columns):
                page_id, url, html, n_bytes, sha1, number, target = (x.as_py() for x in row)
                made = record("revisit" if html is None else "response", page_id, url, None if html is None else html.encode(), n_bytes, sha1, number, target, date)
                held.append(zlib.compress(made + END, 6, 31) if compressed else made)
                size += len(held[-1])
                if size >= row_bytes:
                    yield part()
                    held, size = [], 0
        if held:
            yield part()

    made = records(pages).mapInArrow(run, "part binary").select(F.col("part").cast("string").alias("value"))
    # The writer puts a separator after each row: the last record's end, or a gzip member of no bytes.
    end = _NO_MEMBER.decode("latin-1") if compressed else END.decode()
    made.write.option("maxRecordsPerFile", max(1, archive_bytes // row_bytes)).option("encoding", "ISO-8859-1").option("lineSep", end).text(folder)


class Bad(Exception):
    """A check that failed."""


def _record_at(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where it ends."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Bad("version line")
    fields: dict[bytes, str] = {}
    a = line.end()
    while data[a : a + 2] != b"\r\n":
        found = _HEADER.match(data, a)
        if not found:
            raise Bad("header line")
        name = found[1].lower()
        if name in fields and name != b"warc-concurrent-to":  # the one field that may repeat; else two records ran into each other
            raise Bad("repeated header")
        fields[name] = found[2].decode("utf-8", "replace").strip()
        a = found.end()
    a += 2
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("length")
    b = a + int(length)
    if b + len(END) > len(data):
        raise Bad("truncated")
    if data[b : b + len(END)] != END:
        raise Bad("record end")
    body = data[a:b]
    if (said := fields.get(b"warc-block-digest", "")).startswith("sha1:") and said[5:] != base32(hashlib.sha1(body).hexdigest()):
        raise Bad("block digest")
    kind = fields.get(b"warc-type")
    payload, n_bytes = body, len(body)
    if fields.get(b"content-type", "").replace(" ", "").startswith("application/http"):
        head, _, payload = body.partition(b"\r\n\r\n")
        sizes = re.findall(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        n_bytes = int(sizes[0]) if kind == "revisit" and sizes else len(payload)
    digest = fields.get(b"warc-payload-digest", "")
    digest = digest[5:] if digest.startswith("sha1:") else None
    if kind != "revisit":
        actual = base32(hashlib.sha1(payload).hexdigest())
        if digest not in (None, actual):
            raise Bad("payload digest")
        digest = actual
    out = {"record_type": kind, "record_id": fields.get(b"warc-record-id"), "refers_to": fields.get(b"warc-refers-to"), "target_uri": fields.get(b"warc-target-uri"), "date": fields.get(b"warc-date"), "payload_bytes": n_bytes, "payload_digest": digest, "payload": payload}
    return out, b + len(END)


def _member_at(data: bytes, at: int, piece: int = 1 << 15) -> tuple[bytes, int]:
    """What the gzip member that begins at ``at`` holds, and where it ends."""
    unpacked, out, size = zlib.decompressobj(31), [], 0
    for a in range(at, len(data), piece):
        part = data[a : a + piece]
        try:
            out.append(unpacked.decompress(part))
        except zlib.error:
            raise Bad("gzip member") from None
        size += len(out[-1])
        if size > MEMBER_BYTES:
            raise Bad("gzip member too large")
        if unpacked.eof:
            return b"".join(out), a + len(part) - len(unpacked.unused_data)
    raise Bad("truncated")


def salvage(data: bytes) -> Iterator[dict]:
    """The records and gaps of an archive in order, each with ``begin`` and ``end`` in bytes of the archive."""
    at, gap, why = 0, None, ""
    marks = {MEMBER: -1, VERSION: -1}  # the next place of each, searched for only once passed

    while at < len(data):
        found: list[dict] = []
        try:
            if data.startswith(MEMBER[:2], at):
                inside, end = _member_at(data, at)
                found = [{**r, "begin": at, "end": end} for r in salvage(inside)]
            else:
                one, end = _record_at(data, at)
                found = [{**one, "begin": at, "end": end}]
        except Bad as bad:
            if gap is None:
                gap, why = at, str(bad)
            for mark, place in marks.items():
                if 0 <= place <= at or place == -1:
                    place = data.find(mark, at + 1)
                    marks[mark] = place if place >= 0 else len(data)
            at = min(marks.values())
            continue
        if gap is not None:
            yield {"reason": why, "begin": gap, "end": at}
            found = [{**r, "after_gap": True} for r in found]
        yield from found
        gap, at = None, end
    if gap is not None:
        yield {"reason": why, "begin": gap, "end": len(data)}


_FIELDS = {
    "archive": "string", "begin": "long", "end": "long", "reason": "string", "after_gap": "boolean", "record_type": "string", "record_id": "string", "refers_to": "string",
    "target_uri": "string", "date": "string", "payload_bytes": "long", "payload_digest": "string", "payload": "binary",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``reason`` null) and quarantined gaps (``reason`` set) of all archives under ``path``.

    Columns: archive, begin, end, reason, after_gap, record_type, record_id, refers_to,
    target_uri, date, payload_bytes, payload_digest, payload (null unless ``payloads``).
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for r in salvage(content.as_py()):
                    if not payloads:
                        r["payload"] = None
                    rows.append({"archive": archive, "after_gap": False, **r})
                    size += 512 + len(r.get("payload") or b"")
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[t]) for c, t in _FIELDS.items()], names=list(_FIELDS))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _FIELDS.items()))


def page_records(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of records that :func:`write` made."""
    id_of = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^<urn:x-page:(-?\d+):", 1).try_cast("long")
    whole = found.where("reason is null and record_type in ('response', 'revisit')")
    return whole.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))


def archive_and_read(pages: DataFrame, compressed: bool = True) -> DataFrame:
    """Writes all ``pages`` into new archives of the shared folder, and gives the pages' records as read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/foliant/warc-{uuid.uuid4().hex}"
    write(pages, folder, compressed)
    return page_records(read(spark, folder, payloads=False))
