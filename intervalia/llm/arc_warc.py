"""Legacy archive conversion: ARC version 1 and 2 files to WARC, written and read back.

An ARC file starts with a version block whose second and third line name the version and the fields of
the header lines that follow; every record has one header line, whose last field is the declared length
of its content. `write_arc` makes such files of pages, `read_arc` reads files of either version, as they are or
compressed, by those lines and lengths, and `write` turns what it reads into WARC. `to_warc` synthesises what ARC lacks:
a record id derived from the record, an ISO timestamp, the record type and a payload digest.

Records with equal payloads: the one with the largest id is the response, the others are revisits that
refer to it; payloads smaller than `least` bytes are always responses. Rows with equal id and payload
count as one record, are written as often as they occur under one id, and have the same type. Null and empty payloads
are empty, and equal to each other; a null id is a revisit if an equal payload has an id. Files are plain ARC and WARC 1.1,
compressed as gzip, and are closed at FILE_BYTES, so that one task holds one file; a longer page is a file of its own. An
empty table gives no records. Columns beside page_id, url and html are not read, whatever their names.

Malformed ARC: a header line with the wrong number of fields or a length that is no number is passed over, and reading goes
on at the next line; a record that ends before its declared length, or whose version 2 checksum does not hold, is left
out; a file without a version block has no records. With strict=True parse_arc raises instead.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import shared_dir

#: The header fields of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20240101000000"
#: Bytes of records at which a file is closed.
FILE_BYTES = 8 << 20
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(version: int, records: Iterable[tuple[str, bytes]], date: str = DATE, ip: str = "0.0.0.0") -> bytes:
    """An ARC file of (url, content) records; content usually begins with an HTTP status line."""
    about = f"{version} 0 intervalia\n{FIELDS[version]}\n\n".encode()
    out = [_line(version, "filedesc://segment.arc", about, date, ip, "text/plain"), about, b"\n"]
    for url, content in records:
        out += [_line(version, url, content, date, ip, "text/html"), content, b"\n"]
    return b"".join(out)


def _line(version: int, url: str, content: bytes, date: str, ip: str, kind: str) -> bytes:
    url = re.sub(r"\s", "%20", url) or "-"
    more = "" if version == 1 else f" 200 {hashlib.md5(content).hexdigest()} - 0 segment.arc"
    return f"{url} {ip} {date} {kind}{more} {len(content)}\n".encode()


def parse_arc(data: bytes, strict: bool = True) -> Iterator[dict]:
    """Records of an ARC file after the version block: a dict of its named fields, and `content`.

    A header line is split from its end, as a URL in old files may hold spaces.
    """

    def bad(what: str) -> None:
        if strict:
            raise ValueError(what)

    end = data.find(b"\n")
    size = data[: max(end, 0)].rpartition(b" ")[2]
    about = data[end + 1 : end + 1 + int(size)].split(b"\n") if size.isdigit() else []
    names = about[1].decode("utf-8", "replace").split() if len(about) > 1 else []
    if "Archive-length" not in names or "URL" not in names:
        return bad("not an ARC file")
    at = end + 1 + int(size)
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            return bad("an ARC header line does not end")
        parts = data[at:end].decode("utf-8", "surrogateescape").rsplit(" ", len(names) - 1)
        record = dict(zip(names, parts))
        if len(parts) != len(names) or not re.fullmatch("[0-9]+", record["Archive-length"]):
            bad(f"an ARC header line has {len(parts)} fields, not {len(names)}, or no length")
            at = end + 1
            continue
        size = int(record["Archive-length"])
        if end + 1 + size > len(data):
            bad("an ARC record is shorter than declared")
            at = end + 1
            continue
        content = data[end + 1 : end + 1 + size]
        if re.fullmatch("[0-9a-f]{32}", record.get("Checksum", "")) and hashlib.md5(content).hexdigest() != record["Checksum"]:
            bad("an ARC record does not have its checksum")
            at = end + 1
            continue
        record["content"] = content
        at = end + 1 + size
        yield record


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and body; a head is synthesised for content without one."""
    if content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        if end >= 0:
            return content[: end + 4], content[end + 4 :]
    return b"HTTP/1.0 200 OK\r\n\r\n", content


def to_warc(record: dict, ident: str | None, keeper: str | None, least: int = 0) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it."""
    head, body = http_parts(record["content"])
    digest, url, d = digest_of(body), record["URL"], record["Archive-date"]
    revisit = keeper is not None and keeper != ident and len(body) >= least
    block = head if revisit else head + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{_id(ident, digest)}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {record['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Payload-Length: {len(body)}",
    ]
    if ident is not None:
        lines.append(f"X-Source-Id: {ident}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{_id(keeper, digest)}>", f"X-Refers-To-Source-Id: {keeper}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def _id(ident: str | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(SPACE, f"{ident} {digest}")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


ARCHIVE = "page_id long, url string, ip string, date string, head binary, payload binary, digest string"


def _files(rows: DataFrame, tag: str, end: str) -> str:
    """Writes each binary value as a file of its own in the shared folder; returns their path."""
    path = f"{shared_dir(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)
    return path


def _parts(records: Iterator[bytes], between: bytes) -> Iterator[pa.RecordBatch]:
    """Records joined to values of FILE_BYTES or a little more."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= FILE_BYTES:
            yield pa.RecordBatch.from_pydict({"value": pa.array([between.join(held)], pa.binary())})
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"value": pa.array([between.join(held)], pa.binary())})


def write_arc(pages: DataFrame, version: int | None = None) -> str:
    """Writes pages (page_id, url, html) as ARC files of both versions in turn (or of one); returns their path.

    The id of a page stands in its HTTP head, as ARC has no place for it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for b in batches:
            for ident, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                mark = "" if ident is None else f"X-Source-Id: {ident}\r\n"
                held.append((url, f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n{mark}\r\n".encode() + payload.as_py()))
                size += len(held[-1][1])
                if size >= FILE_BYTES:
                    turn += 1
                    yield pa.RecordBatch.from_pydict({"value": pa.array([arc_file(version or 1 + turn % 2, held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([arc_file(version or 1 + turn % 2, held)], pa.binary())})

    return _files(rows.mapInArrow(archive, "value binary"), "arc", "\n")


def read_arc(spark, path: str, bodies: bool = True) -> DataFrame:
    """ARCHIVE of the records of the ARC files at a path, one file at a time in a task; what is malformed is passed over.

    Without bodies, page_id and digest alone.
    """
    names = [x.split()[0] for x in ARCHIVE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()]
    own = range(len(names)) if bodies else (0, len(names) - 1)

    def rows(data: bytes) -> Iterator[tuple]:
        for r in parse_arc(data, strict=False):
            head, body = http_parts(r["content"])
            ident = re.search(rb"\r\nX-Source-Id: (-?[0-9]{1,19})\r\n", head)
            text = lambda k: r.get(k, "").encode("utf-8", "surrogateescape").decode("utf-8", "replace")  # noqa: B023, E731
            yield int(ident[1]) if ident else None, text("URL"), text("IP-address"), text("Archive-date"), head, body, digest_of(body)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data, held, size = _plain(content.as_py()), [], 0
                for row in rows(data):
                    held.append([row[k] for k in own])
                    size += len(row[5])
                    if size >= FILE_BYTES or len(held) >= 2000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*held), own)], names=[names[k] for k in own])

    schema = ", ".join(x for k, x in enumerate(ARCHIVE.split(", ")) if k in own)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def _plain(data: bytes) -> bytes:
    """The bytes of a file that may be compressed; a broken end of a compressed one is cut off."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(rest))
        except zlib.error:
            break
        rest = d.unused_data
    return b"".join(out)


def write(archive: DataFrame, least: int = 0, digests: DataFrame | None = None) -> str:
    """Converts ARCHIVE rows to WARC files in the shared folder; returns their path.

    Payloads meet by digest with partial aggregation, so a hot payload is one row for each task; only digests are
    shuffled for that. They may be given by themselves (page_id, digest), if that is cheaper than the archive again.
    """
    rows = archive
    each = (archive if digests is None else digests).select("page_id", "digest").distinct()
    keepers = each.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    flags = each.join(keepers, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keeper")
    rows = rows.join(flags, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "ip", "date", "head", "payload", "keeper")

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                plain = [b.column(k).to_pylist() for k in (0, 1, 2, 3, 6)]
                for ident, url, ip, date, keeper, head, payload in zip(*plain, b.column(4), b.column(5)):
                    record = {"URL": url, "IP-address": ip, "Archive-date": date if re.fullmatch("[0-9]{14}", date) else DATE, "content": head.as_py() + payload.as_py()}
                    yield to_warc(record, None if ident is None else str(ident), None if keeper is None else str(keeper), least)

        yield from _parts(records(), b"\r\n\r\n")

    return _files(rows.mapInArrow(convert, "value binary"), "warc", "\r\n\r\n")


def convert(spark, path: str, least: int = 0) -> str:
    """Converts the ARC files at a path to WARC files; returns their path."""
    return write(read_arc(spark, path), least, read_arc(spark, path, bodies=False))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"


def read(spark, path: str) -> DataFrame:
    """A row for each record of the WARC files at path; digests of payloads are checked."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [_row(h, block) for h, block in parse_warc(_plain(content.as_py()))]
                cols = list(zip(*rows)) or [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def _row(h: dict[str, str], block: bytes) -> tuple:
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and digest_of(http_parts(block)[1]) != digest:
        raise ValueError(f"the payload of {h['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return number("X-Source-Id"), int(h["X-Payload-Length"]), digest, h["WARC-Type"], number("X-Refers-To-Source-Id"), h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]
