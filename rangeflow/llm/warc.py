"""WARC archives from legacy ARC records.

An ARC file has one version block and then records whose header line depends
on the version: five fields in version 1, ten in version 2, the declared
length last in both. The converter reads header lines and declared lengths,
and makes the WARC record that says the same: a record id, an ISO date, a
type, and SHA-1 digests of block and payload. What is not HTTP becomes a ``resource``.

A WARC file begins with a ``warcinfo`` record, holds about ``file_bytes`` of records, and
each record is a gzip member of its own, so that a reader can go to any of them by its
place. Files are rows of bytes that Spark's text writer commits to any Hadoop file
system, one a file; its line separator, a zero byte at the end, is padding that
gzip allows. They are read back as whole files, by declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, new_path, small

END = b"\r\n\r\n"

# Field names of an ARC version block, in their order.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    #: Payloads of fewer bytes are always stored in full.
    least_bytes: int = 0
    #: When pages carry no date: the archive's.
    date: str = "20000101000000"
    #: Bytes of records before compression at which a file is full (a longer record has one of its own).
    file_bytes: int = 32 << 20


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    #: Where its header line begins in the uncompressed file.
    offset: int = 0


def _address(url: bytes) -> str:
    """An address without characters that would end a field of a header line."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url)


class _Pieces:
    """A file that arrives in pieces, of which only what is needed is held."""

    def __init__(self, chunks: Iterable[bytes]):
        self.more, self.held, self.at = iter(chunks), bytearray(), 0

    def _grow(self) -> bool:
        for chunk in self.more:
            if chunk:
                self.held += chunk
                return True
        return False

    def _cut(self, size: int, drop: int = 0) -> bytes:
        found = bytes(self.held[:size])
        del self.held[: size + drop]
        self.at += size + drop
        return found

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``, or None if that doesn't come."""
        start = 0
        while (stop := self.held.find(end, start)) < 0:
            start = max(0, len(self.held) - len(end) + 1)
            if not self._grow():
                return None
        return self._cut(stop, len(end))

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self._grow():
            pass
        return self._cut(size)


def arc_file(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """A whole ARC file of one version."""
    about = b"%d 0 rangeflow\n%s\n" % (version, ARC_FIELDS[version])
    spare = b" 200 - - 0 %s" % name.encode() if version == 2 else b""
    out = [b"filedesc://%s 0.0.0.0 20000101000000 text/plain%s %d\n" % (name.encode(), spare, len(about)), about, b"\n"]
    for r in records:
        head = " ".join((r.url, r.ip, r.date, r.content_type)).encode("ascii")
        out += [head, spare, b" %d\n" % len(r.body), r.body, b"\n"]
    return b"".join(out)


def read_arc(chunks: Iterable[bytes]) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, by their declared lengths."""
    source, version = _Pieces(chunks), None
    while True:
        begin = source.at
        line = source.until(b"\n")
        if line is None:
            if source.held.strip():
                raise ValueError(f"ARC header line at {begin} does not end")
            return
        if not line.strip():  # what separates records
            continue
        last = line.rsplit(b" ", 1)[-1].strip()
        if not last.isdigit():
            raise ValueError(f"ARC header line at {begin} declares no length: {line[:80]!r}")
        length = int(last)
        body = source.take(length)
        if len(body) < length:
            raise ValueError(f"ARC record at {begin} declares {length} bytes and has {len(body)}")
        if version is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        fields = line.strip().rsplit(b" ", len(ARC_FIELDS[version].split()) - 1)
        if len(fields) != len(ARC_FIELDS[version].split()):
            raise ValueError(f"ARC version {version} header line at {begin} has {len(fields)} fields")
        ip, date, kind = (x.decode("latin-1") for x in fields[1:4])
        yield ArcRecord(version, _address(fields[0]), ip, date, kind, body, begin)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None) -> str:
    """A version 8 UUID (application-defined) that holds the page's number."""
    number = 0 if page_id is None else page_id & (1 << 64) - 1
    tag = 0x7265636F7264 if page_id is not None else 0x6E6F6E756D62
    value = tag << 80 | 8 << 76 | (number >> 52) << 64 | 2 << 62 | (number & (1 << 52) - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def numbered(record: str) -> int | None:
    """The page's number in a record id."""
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 80 != 0x7265636F7264:
        return None
    number = (value >> 64 & 0xFFF) << 52 | value & (1 << 52) - 1
    return number - (1 << 64) if number >> 63 else number


def named_id(*names: object) -> str:
    """A record id that follows from names (the file, the place in it, the address and the date)."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, names)))}>"


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with the empty line that ends it, and payload."""
    for end in (END, b"\n\n"):
        if (at := block.find(end)) >= 0:
            return block[: at + len(end)], block[at + len(end) :]
    return block, b""


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


def _iso(date: str) -> str:
    d = date + "00000101000000"[len(date) :]  # shorter dates name a year, month or day
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in fields], f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + END + block + END


def to_warc(record: ArcRecord, identifier: str, original: str | None = None) -> bytes:
    """The equivalent WARC record; one with an ``original`` (a record id) revisits it."""
    http = record.body.startswith(b"HTTP/")
    head, payload = _split_http(record.body) if http else (b"", record.body)
    kind = "revisit" if original else "response" if http else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", _iso(record.date)), ("WARC-Target-URI", record.url)]
    if original:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original)]
    if record.ip not in ("0.0.0.0", "-", ""):  # unknown
        fields.append(("WARC-IP-Address", record.ip))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    fields.append(("Content-Type", "application/http; msgtype=response" if http else _address(record.content_type.encode("latin-1"))))
    return _record(fields, head if original else record.body)


def _member(record: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def warc_files(records: Iterable[tuple[str, str, bytes]], file_bytes: int) -> Iterator[bytes]:
    """Whole WARC files from (record id, ARC date, record), each with its ``warcinfo``."""
    out, size = [], 0
    for identifier, date, record in records:
        if out and size + len(record) > file_bytes:
            yield b"".join(out)
            out, size = [], 0
        if not out:
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", named_id("warcinfo", identifier)), ("WARC-Date", _iso(date)), ("Content-Type", "application/warc-fields")]
            out.append(_member(_record(about, b"software: rangeflow\r\nformat: WARC File Format 1.0\r\n")))
        out.append(_member(record))
        size += len(record)
    if out:
        yield b"".join(out)


def read_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks, by declared lengths; ``chunks`` are pieces of an archive in order."""
    source = _Pieces(chunks)
    while (head := source.until(END)) is not None:
        first, *lines = head.decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["Content-Length"])
        block = source.take(size)
        if len(block) < size or source.take(len(END)) != END:
            raise ValueError("an archive ends inside a record")
        yield fields, block
    if source.held:
        raise ValueError("an archive ends inside a record")


def _inflated(data: bytes, step: int = 256 << 10, most: int = 4 << 20) -> Iterator[bytes]:
    """The content of a file, gzipped (one member or many, zeros after the last) or not, in pieces of bounded size."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    unpack = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        rest = data[at : at + step]
        while rest:
            if unpack.eof:  # the next member
                rest = rest.lstrip(b"\0")
                unpack = zlib.decompressobj(31) if rest else unpack
            if rest:
                yield unpack.decompress(rest, most)
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
    if not unpack.eof:
        yield unpack.flush()


def _page_record(url: str | None, html: str | None, version: int, date: str) -> ArcRecord:
    payload = (html or "").encode("utf-8")
    head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return ArcRecord(version, _address((url or "urn:none").encode("utf-8")), "0.0.0.0", date, "text/html", head.encode("ascii") + payload)


def _write(files: DataFrame, path: str) -> None:
    """Each row's bytes as a file."""
    files.select(F.col("file").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, p: WarcParams = WarcParams()) -> None:
    """Write ``pages`` as gzipped WARC files, by way of ARC records of both versions.

    Of pages with equal payloads of at least ``least_bytes`` the one with the
    largest id is a response, and the others revisit it. Only digests are
    grouped; the pages themselves join the list of revisits, which is
    broadcast up to 200,000 (of some 100 bytes) and else met by page id. A null html is an empty
    payload, a null url ``urn:none``; pages without an id, and pages that repeat, are
    records of their own; other columns are ignored; an empty table writes no archive.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = named.where(F.col("bytes") >= p.least_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and original is not null").select("digest", "original"), "groups")
    again = named.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    again = cut(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original").distinct(), "revisits")
    same = pages["page_id"].eqNullSafe(again["_page"]) & (F.sha1(payload) == again["_digest"])
    marked = pages.join(small(again, 200_000), same, "left").select("page_id", "url", "html", "original")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                for version in ARC_FIELDS:
                    mine = [r for r in rows if (r["page_id"] or 0) % 2 + 1 == version]
                    image = arc_file([_page_record(r["url"], r["html"], version, p.date) for r in mine], version)
                    for r, record in zip(mine, read_arc([image]), strict=True):
                        own, original = record_id(r["page_id"]), r["original"]
                        yield own, record.date, to_warc(record, own, None if original is None else record_id(original))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in warc_files(records(batches), p.file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

    _write(marked.mapInArrow(convert, "file binary"), path)


def convert_archives(spark: SparkSession, source: str, target: str, p: WarcParams = WarcParams()) -> None:
    """Convert the ARC files at ``source`` (of either version, gzipped or not) to WARC files at ``target``.

    Every record is converted, and its id follows from its file's name, its place there, its
    address and its date. A file that breaks off or declares a wrong length is an error; one without
    records, or no file at all, gives no archive. Spark reads whole files (of less than 2 GB; ARC
    files have some 100 MB by convention); their content is unpacked in pieces.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for record in read_arc(_inflated(content.as_py())):
                    own = named_id(path.rsplit("/", 1)[-1], record.offset, record.url, record.date)
                    yield own, record.date, to_warc(record, own)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in warc_files(records(batches), p.file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

    _write(spark.read.format("binaryFile").load(source).select("path", "content").mapInArrow(convert, "file binary"), target)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id) of every record but ``warcinfo``.

    Digests are checked. Page ids are those that :func:`record_id` put into the record ids, null for
    other records; bytes of a revisit's payload are what its HTTP head says (null if that is silent).
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in read_warc(_inflated(content.as_py())):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = _split_http(block) if fields["Content-Type"].startswith("application/http") else (b"", block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if sha1_base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or kind != "revisit" and sha1_base32(payload) != digest:
                        raise ValueError(f"a digest doesn't hold: {fields['WARC-Record-ID']}")
                    size = http_field(head, b"Content-Length") if kind == "revisit" else len(payload)
                    rows.append(
                        {
                            "page_id": numbered(fields["WARC-Record-ID"]),
                            "payload_bytes": None if size is None else int(size),
                            "payload_digest": digest,
                            "record_type": kind,
                            "refers_to": numbered(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                            "url": fields["WARC-Target-URI"],
                            "date": fields["WARC-Date"],
                            "record_id": fields["WARC-Record-ID"],
                        }
                    )
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(
        parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string"
    )


_READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64())]
    + [(c, pa.string()) for c in ("payload_digest", "record_type")]
    + [("refers_to", pa.int64())]
    + [(c, pa.string()) for c in ("url", "date", "record_id")]
)


def round_trip(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back.

    Null html is an empty payload, a null url the address ``urn:none``; a page
    without an id is a record without a number: if others have its payload
    it revisits the largest id among them, otherwise it is a response. Rows with one id
    and one payload are records of one kind. An empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, p)
    return read_archives(pages.sparkSession, path)
