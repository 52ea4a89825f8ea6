"""Legacy archive converter: ARC files of versions 1 and 2 become WARC files.

An ARC file opens with a version block that names the fields of its header lines; each record is a header line, the
declared number of bytes, and a newline. The converter reads the fields as the version block lists them, and gives every
record what WARC asks for and ARC lacks: an identifier made from what the record is (so reruns agree), an ISO timestamp,
a record type and digests. Of records with equal payloads one stays a response and the others become revisits.

Archives are written with Spark's text writer: a WARC record ends with two line ends and an ARC record with one, which
are set as line separators, so part files are archives as they stand. Reading takes whole files, as an archive without
record marks can only be read from its start; a file is as large as the input partition that it was written from.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, read_table, texts
from demandspark.session import materialise, scratch

# The fields of ARC header lines, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes of records that are handed on together.
CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunks(rows: Iterable[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK bytes from ``(bytes, row)``."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= CHUNK:
            yield batch_of(schema, *zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield batch_of(schema, *zip(*held, strict=True))


def arc_header(version: int, name: str, url: str, ip: str, date: str, mime: str, code: str, offset: int, length: int) -> bytes:
    # A header line is split at spaces, so there are none inside a field.
    known = {
        "URL": "%20".join(url.split()) or "urn:none", "IP-address": ip, "Archive-date": date, "Content-type": mime,
        "Result-code": code, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length),
    }
    return " ".join(known[f] for f in ARC_FIELDS[version].split()).encode()


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000") -> None:
    """Write ``pages`` (page_id, url, html) as gzipped ARC files, those of odd partitions in version 2.

    Null html is an empty payload, a null url a placeholder; rows of any kind give one record each.
    """
    out = pa.schema([("value", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}.arc"
        block = f"{version} 0 demandspark\n{ARC_FIELDS[version]}\n".encode()
        offset = 0

        def records() -> Iterator[tuple[int, tuple]]:
            nonlocal offset
            for batch in batches:
                urls, ids = column(batch, "url").to_pylist(), column(batch, "page_id").to_pylist()
                for url, page_id, html in zip(urls, ids, texts(batch, "html"), strict=True):
                    if not offset:
                        yield record(f"filedesc://{name}", "0.0.0.0", "text/plain", block)
                    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(html)}\r\n\r\n"
                    yield record(url or "", "127.0.0.1", "text/html", http.encode() + html)

        def record(url: str, ip: str, mime: str, body: bytes) -> tuple[int, tuple]:
            nonlocal offset
            data = arc_header(version, name, url, ip, date, mime, "200", offset, len(body)) + b"\n" + body
            offset += len(data) + 1
            return len(data), (data,)

        yield from chunks(records(), out)

    rows = pages.select("page_id", "url", "html").mapInArrow(run, "value binary")
    write_records(rows, path, "\n")


def write_records(rows: DataFrame, path: str, end: str) -> None:
    # The cast keeps the bytes as they are; the text writer writes them unchanged.
    text = rows.select(F.col("value").cast("string"))
    text.write.option("lineSep", end).option("compression", "gzip").text(path)


def archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def open_archive(content: bytes) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), CHUNK)


def iso_date(date: str) -> str:
    """ARC dates have 14 digits, or 12 or 8 in old files; what is missing is the start of the period."""
    d = (date if date.isdigit() else "").ljust(4, "0")
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """``(header fields, offset, body)`` of every record of one ARC file, the version block included."""
    stream = open_archive(content)
    fields = ARC_FIELDS[1].split()
    at = 0
    while line := stream.readline():
        if not line.strip():
            at += len(line)
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text.startswith("filedesc:"):
            # Either version ends with the length, and only version 2 has ten fields.
            fields = ARC_FIELDS[2 if text.count(" ") >= 9 else 1].split()
        # From the right, since only a URL may hold stray spaces.
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {text[:80]!r}")
        head = dict(zip(fields, values, strict=True))
        length = int(values[-1])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"the record at byte {at} declares {length} bytes and has {len(body)}")
        if text.startswith("filedesc:"):
            lines = body.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and lines[1].startswith("URL "):
                fields = lines[1].split()
        yield head, at, body
        at += len(line) + length


RECORD = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("ip", pa.string()),
     ("mime", pa.string()), ("page_id", pa.int64()), ("http", pa.binary()), ("payload", pa.binary()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
RECORD_DDL = (
    "record_id string, type string, uri string, date string, ip string, mime string, page_id long, http binary, "
    "payload binary, payload_bytes long, payload_digest string"
)


def http_field(http: bytes, name: bytes) -> bytes | None:
    for line in http.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def converted(head: dict[str, str], at: int, body: bytes, file: str, with_payload: bool) -> tuple:
    uri = head["URL"]
    http, payload = b"", body
    if uri.startswith("filedesc:"):
        kind = "warcinfo"
    elif body.startswith(b"HTTP/"):
        kind = "response"
        start, sep, rest = body.partition(b"\r\n\r\n")
        http, payload = start + sep, rest
    else:
        kind = "resource"
    digest = base32_sha1(payload)
    name = f"{file} {at} {uri} {head['Archive-date']} {digest}"
    mark = http_field(http, b"x-page-id")
    page_id = int(mark) if mark is not None else None
    return (
        f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", kind, uri, iso_date(head["Archive-date"]), head["IP-address"],
        head["Content-type"], page_id, http if with_payload else None, payload if with_payload else None, len(payload), digest,
    )


def convert_arc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """WARC records of ARC files; without payloads the rows are an index of a few hundred bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for content in column(batch, "content"):
                    file = ""
                    for head, at, body in arc_records(content.as_py()):
                        if head["URL"].startswith("filedesc:"):
                            file = head["URL"].removeprefix("filedesc://")
                        yield (len(body) if with_payload else 400), converted(head, at, body, file, with_payload)

        yield from chunks(records(), RECORD)

    return files.mapInArrow(run, RECORD_DDL)


def first_responses(index: DataFrame, min_bytes: int) -> DataFrame:
    """``(digest, to_id, to_page)``: of payloads that several responses share, the record that the others revisit: the
    one with the largest page_id (then the largest record id; nulls last)."""
    shared = index.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    best = F.max(F.struct("page_id", "record_id"))
    groups = shared.groupBy(F.col("payload_digest").alias("digest")).agg(F.count("*").alias("n"), best.alias("best"))
    groups = groups.where("n > 1").select("digest", F.col("best.record_id").alias("to_id"), F.col("best.page_id").alias("to_page"))
    return materialise(groups, "responses")


def warc_record(r: dict) -> bytes:
    """The bytes of one record up to its closing line ends."""
    kind, body, extra = r["type"], r["http"] + r["payload"], []
    if r["to_id"] is not None:
        kind, body = "revisit", r["http"]
        extra = ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{r['to_id']}>"]
        if r["to_page"] is not None:
            extra.append(f"X-Refers-To-Page-Id: {r['to_page']}")
    if r["page_id"] is not None:
        extra.append(f"X-Page-Id: {r['page_id']}")
    mime = {"warcinfo": "application/warc-fields", "resource": r["mime"]}.get(kind, "application/http; msgtype=response")
    if kind == "warcinfo":
        body = b"software: demandspark\r\nformat: WARC File Format 1.0\r\nsource: " + r["uri"].encode() + b"\r\n"
        extra.append(f"WARC-Filename: {r['uri'].removeprefix('filedesc://')}.warc.gz")
    else:
        extra += [f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}",
                  f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", *extra,
             f"WARC-Block-Digest: sha1:{base32_sha1(body)}", f"Content-Type: {mime}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body


def arc_to_warc(files: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Convert ARC files to gzipped WARC files. Payloads under ``min_bytes`` never become revisits."""
    firsts = first_responses(convert_arc(files, with_payload=False), min_bytes)
    records = convert_arc(files)
    same = (F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)
    met = records.join(firsts, (F.col("payload_digest") == F.col("digest")) & same & (F.col("record_id") != F.col("to_id")), "left")
    out = pa.schema([("value", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    (r,) = batch.slice(i, 1).to_pylist()
                    data = warc_record(r)
                    yield len(data), (data,)

        yield from chunks(rows(), out)

    write_records(met.mapInArrow(run, "value binary"), path, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = open_archive(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one must begin: {line[:80]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        length = int(head["content-length"])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"{head.get('warc-record-id')} declares {length} bytes and has {len(body)}")
        yield head, body


PAGE = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())]
)


def read_warc(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of WARC files. The digest and length of a response are taken from its bytes, those of a
    revisit from its header; a response whose header names another digest is an error. Revisits have a null payload."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for content in column(batch, "content"):
                    for head, body in warc_records(content.as_py()):
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        payload, length = None, int(head["x-payload-length"])
                        if kind == "response":
                            payload = body.partition(b"\r\n\r\n")[2]
                            if base32_sha1(payload) != digest or len(payload) != length:
                                raise ValueError(f"{head['warc-record-id']} does not have the payload it declares")
                        ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                        yield (
                            (len(payload or b"") if with_payload else 200) + 400,
                            (ids[0], length, digest, kind, ids[1], head["warc-target-uri"], head["warc-date"],
                             head["warc-record-id"].strip("<>"), payload if with_payload else None),
                        )

        yield from chunks(rows(), PAGE)

    ddl = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, "
        "date string, record_id string, payload binary"
    )
    return archives(spark, path).mapInArrow(run, ddl)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    legacy, new = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(read_table(spark, sf_dir, "pages"), legacy)
    arc_to_warc(archives(spark, legacy), new, min_bytes=0)
    back = read_warc(spark, new, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
d AS (SELECT h, best, strlen(h) AS n, lower(sha1(h)) AS x FROM b),
e AS (SELECT h, best, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32)::BIGINT, 1)), '') AS s FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM p JOIN e USING (h)
"""
