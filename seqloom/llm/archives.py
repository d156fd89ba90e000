"""Legacy ARC archives (versions 1 and 2) and their conversion to WARC 1.1.

`write_arc` stores captures as ARC files, `read_arc` parses their header lines by the fields that each file's version
block names and takes content by its declared length, `to_warc` gives each record a WARC identifier, timestamp, type
and digests, `write_warc` and `read_warc` store and read those. Archives are ordinary gzip files of about CHUNK bytes of
content, written by Spark's text writer (a record is a row; the writer's line separator ends it), so they may lie on any
file system Spark knows; names derive from the task, so that a task run again writes the same archive.

Of records with equal payloads of at least `SMALL` bytes the one with the smallest page id (then record id) is the
response; the others revisit it and keep only their HTTP headers. Only digests that occur twice or more are joined
back, by broadcast if they are few, else salted, so that a payload held by a third of all captures is spread.

Null payloads are empty. Null addresses become urn:page:none; white space in addresses is escaped, as header lines are
split at spaces. Null page ids stay null and come last in the choice of the response. Repeated rows are captures of
their own: one of them is the response. Archives that break the format raise ValueError with the place.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bounded, shared_folder, small_batches, staged

CHUNK = 8 << 20
SMALL = 100
CAPTURED = "20240101000000"
SALTS = 16

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"

STORED = "archive string, place long, record binary"
RECORDS = (
    "page_id long, url string, date string, ip string, record_id string, head binary, payload binary,"
    " payload_bytes long, payload_digest string"
)
READ = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, date string, url string, payload binary"


def _chunks(records: Iterator[bytes], opening) -> Iterator[pa.RecordBatch]:
    """Number records into archives of about CHUNK bytes, each begun by opening(name)."""
    task = TaskContext.get().partitionId()
    chunk, held, place, rows = 0, CHUNK, 0, []
    size = 0
    for record in records:
        if held >= CHUNK:
            name, held, place, chunk = f"a{task:06d}-{chunk:06d}", 0, 0, chunk + 1
            rows.append((name, 0, opening(name)))
        place += 1
        held += len(record)
        size += len(record)
        rows.append((name, place, record))
        if size >= CHUNK:
            yield _stored(rows)
            rows, size = [], 0
    if rows:
        yield _stored(rows)


def _stored(rows: list[tuple]) -> pa.RecordBatch:
    names, places, records = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(records, pa.binary())], ["archive", "place", "record"])


def _store(rows: DataFrame, path: str, end: str) -> None:
    (
        rows.sortWithinPartitions("archive", "place")
        .select("archive", F.col("record").cast("string").alias("value"))
        .write.partitionBy("archive")
        .option("lineSep", end)
        .option("compression", "gzip")
        .text(path)
    )


def arc_version(name: str) -> int:
    """Archives of even tasks are written in version 1, of odd ones in version 2."""
    return 1 + int(name[1:7]) % 2


def _arc_opening(name: str) -> bytes:
    version = arc_version(name)
    body = f"{version} 0 seqloom\n{ARC_FIELDS[version]}\n".encode()
    line = f"filedesc://{name}.arc 0.0.0.0 {CAPTURED} text/plain"
    line += f" 200 - - 0 {name}.arc {len(body)}" if version == 2 else f" {len(body)}"
    return line.encode() + b"\n" + body


def address(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:page:none"


def _http(page_id: int | None, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    version = 1 + TaskContext.get().partitionId() % 2
    for batch in batches:
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            content = _http(page_id, html or b"") + (html or b"")
            line = f"{address(url)} 192.0.2.1 {CAPTURED} text/html"
            if version == 2:
                line += f" 200 {hashlib.md5(content).hexdigest()} - 0 -"
            yield f"{line} {len(content)}\n".encode() + content


def write_arc(pages: DataFrame, path: str) -> None:
    """`pages` (page_id, url, html) as ARC files below `path`."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary"))
    _store(rows.mapInArrow(lambda batches: _chunks(_arc_records(batches), _arc_opening), STORED), path, "\n")


def parse_arc(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(header fields, offset, content) of every record after the version block."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        names = fields or ["URL", "Archive-length"]
        # Sloppy writers left spaces in addresses; all other fields have none.
        parts = line.rsplit(" ", len(names) - 1)
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"{name}: no record header at byte {at}")
        length = int(parts[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"{name}: record at byte {at} is shorter than the {length} bytes it declares")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError(f"{name}: no version block")
            version, columns = content.decode().split("\n")[:2]
            if not version.startswith(("1 ", "2 ")):
                raise ValueError(f"{name}: unknown version {version!r}")
            fields = columns.split(" ")
        else:
            yield dict(zip(fields, parts, strict=True)), at, content
        at = end + 1 + length
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and body; a record without HTTP is all body."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def iso_date(date: str) -> str:
    """14 digits (shorter ones are filled up) as a WARC timestamp."""
    d = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name = path.rpartition("archive=")[2].partition("/")[0]
            rows = []
            for fields, at, block in parse_arc(content, path):
                head, payload = _split_http(block)
                page = _header(head, "X-Page-Id")
                key = hashlib.sha256(f"{name} {at} {fields['URL']} {fields['Archive-date']}".encode()).digest()
                rows.append(
                    (
                        int(page) if page is not None else None,
                        fields["URL"],
                        iso_date(fields["Archive-date"]),
                        fields["IP-address"],
                        f"<urn:uuid:{uuid.UUID(bytes=key[:16], version=4)}>",
                        head,
                        payload,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                    )
                )
            if rows:
                yield _batch(rows, RECORDS)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names = [c.split() for c in ddl.split(",")]
    return pa.record_batch([pa.array(v, _ARROW[t]) for v, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def read_arc(spark, path: str) -> DataFrame:
    """Every record of the ARC files below `path`, with what its WARC form needs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_converted, RECORDS)


def to_warc(records: DataFrame, small: int = SMALL) -> DataFrame:
    """Each record with its type and, for revisits, the response it refers to."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    keys = staged(records.select("payload_digest", "payload_bytes", order.alias("o")), "digests")
    held = keys.where(F.col("payload_bytes") >= small).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    held = staged(held.where("n > 1").select("payload_digest", "first"), "repeated")
    few = bounded(held)
    if few is held:  # too many to broadcast: salted, for payloads that very many records share
        few = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        records = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
        joined = records.join(few, ["payload_digest", "salt"], "left").drop("salt")
    else:
        joined = records.join(few, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("record_id") != F.col("first.record_id"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("first", F.when(revisit, F.col("first")))


def _warc_record(kind: str, record_id: str, date: str, block: bytes, **fields: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def _warc_opening(name: str) -> bytes:
    key = uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)
    return _warc_record("warcinfo", f"<urn:uuid:{key}>", iso_date(CAPTURED), b"format: WARC File Format 1.1\r\nsoftware: seqloom\r\n", WARC_Filename=f"{name}.warc.gz", Content_Type="application/warc-fields")


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for r in batch.to_pylist():
            fields = {"WARC_Target_URI": r["url"], "WARC_IP_Address": r["ip"], "WARC_Payload_Digest": f"sha256:{r['payload_digest']}"}
            fields["Content_Type"] = "application/http;msgtype=response" if r["head"] else "application/octet-stream"
            block = r["head"] + r["payload"]
            if r["record_type"] == "revisit":
                first = r["first"]
                block = r["head"]
                fields |= {"WARC_Profile": REVISIT_PROFILE, "WARC_Refers_To": first["record_id"], "WARC_Refers_To_Target_URI": first["url"], "WARC_Refers_To_Date": first["date"]}
                if first["page_id"] is not None:
                    fields["X_Refers_To_Page_Id"] = str(first["page_id"])
            yield _warc_record(r["record_type"], r["record_id"], r["date"], block, **fields)


def write_warc(records: DataFrame, path: str) -> None:
    _store(records.mapInArrow(lambda batches: _chunks(_warc_records(batches), _warc_opening), STORED), path, WARC_END)


def parse_warc(data: bytes, name: str = "") -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at : end + 2]
        length = _header(head, "Content-Length")
        if end < 0 or not head.startswith(b"WARC/") or length is None:
            raise ValueError(f"{name}: no record header at byte {at}")
        block = data[end + 4 : end + 4 + int(length)]
        if len(block) != int(length):
            raise ValueError(f"{name}: record at byte {at} is shorter than the {length} bytes it declares")
        yield head, block
        at = end + 4 + int(length) + 4


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            for head, block in parse_warc(content, path):
                kind = _header(head, "WARC-Type")
                if kind == "warcinfo":
                    continue
                http, payload = _split_http(block)
                page, other = _header(http, "X-Page-Id"), _header(head, "X-Refers-To-Page-Id")
                size = int(_header(http, "Content-Length") or 0) if kind == "revisit" else len(payload)
                digest = _header(head, "WARC-Payload-Digest").partition(":")[2]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: a payload does not have its digest")
                rows.append(
                    (
                        int(page) if page is not None else None,
                        _header(head, "WARC-Record-ID"),
                        size,
                        digest,
                        kind,
                        int(other) if other is not None else None,
                        _header(head, "WARC-Date"),
                        _header(head, "WARC-Target-URI"),
                        payload,
                    )
                )
            if rows:
                yield _batch(rows, READ)


def read_warc(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read_back, READ)


def archive_report(pages: DataFrame) -> DataFrame:
    """Pages stored as ARC, converted to WARC, and read back: one row per page."""
    spark = pages.sparkSession
    small_batches(spark)
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, f"{arc}/t")
    write_warc(to_warc(read_arc(spark, f"{arc}/t")), f"{warc}/t")
    return read_warc(spark, f"{warc}/t").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ARCHIVE_SQL = f"""
with payloads as (
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
),
firsts as (select payload_digest, min(page_id) as first_id from payloads where payload_bytes >= {SMALL} group by 1)
select page_id, payload_bytes, payload_digest,
       case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from payloads left join firsts using (payload_digest)
"""
