"""WARC archives with a two-level capture index.

Each task writes its pages in the order of their key (host reversed, then path; then page id), so reading captures in
index order reads every archive file from front to back. Each record is its own gzip member. The index has two levels: lines sorted
by key in compressed blocks of LINES, and a sparse directory with an entry for each block. The directory lies in the shared folder, a part for
each task that wrote a range of the index; only one row for each part is known to the driver and goes to the workers. A lookup searches these
and the part's entries by bisection, reads one block by its range, searches that by bisection, and reads the record by its range. Lookups of many keys
are dealt by key range, so a task holds one part and one block at a time.
"""

from __future__ import annotations

import gzip
import json
import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import dropped, new_path, written
from lattica.llm.words import bounded_batches

LINES = 1_000
#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 100
#: Compressed bytes after which a task begins another archive file.
FILE_BYTES = 512 << 20
#: Fixed value: the WARC version and date that every record carries.
VERSION, DATE = "WARC/1.1", "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str):
    """The key: host reversed and comma-joined, ")", the rest. No host: the URL itself."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def surt_of(url: str | None) -> str:
    """surt() of one URL."""
    u = url or ""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*", u)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + u[m.end() :] if m and m[1] else u


def _fs(path: str):
    from pyarrow.fs import FileSystem

    try:
        return FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archive files need a folder that pyarrow.fs opens, which {path!r} is not; pass another as path") from e


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    from hashlib import sha256

    revisit = refers_to is not None
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha256:{sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


Place = tuple[str, bool, float]


def place(key: str, id: int | None) -> Place:
    """A capture's place in the order of the index; those without an id come first."""
    return key, id is not None, id or 0


def _span(firsts: list[Place], low: Place, high: Place) -> range:
    """Which of the sorted ranges that begin at firsts may hold places from low to high."""
    return range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high))


class Reader:
    """Lookups by bisection. parts: (first_key, first_id, file, offset, length) of the directory's parts, in key order."""

    def __init__(self, parts: list[tuple]):
        self.parts, self.firsts = parts, [place(*p[:2]) for p in parts]
        self.held: dict[str, tuple] = {}  # "part" and "block": where it lies, its lines, their places

    def _lines(self, kind: str, where: tuple) -> tuple[list[list], list[Place]]:
        if kind not in self.held or self.held[kind][0] != where:
            lines = read_lines(*where)
            self.held[kind] = where, lines, [place(*x[:2]) for x in lines]
        return self.held[kind][1:]

    def captures(self, low: Place, high: Place) -> Iterator[list]:
        """Lines (key, id, file, offset, length) with places from low to high."""
        for p in _span(self.firsts, low, high):
            blocks, firsts = self._lines("part", tuple(self.parts[p][2:5]))
            for k in _span(firsts, low, high):
                lines, places = self._lines("block", tuple(blocks[k][2:5]))
                yield from lines[bisect_left(places, low) : bisect_right(places, high)]


@dataclass
class Archive:
    """Folder of the archive files; parts: (first_key, first_id, file, offset, length, blocks), a row for each task that wrote a range of the index."""

    path: str
    parts: DataFrame

    def places(self) -> list[tuple]:
        """The parts in key order: as many as the index has tasks."""
        return sorted((tuple(r)[:5] for r in self.parts.collect()), key=lambda p: place(*p[:2]))

    def lookup(self, url: str, reader: Reader | None = None) -> list[tuple[dict[str, str], bytes]]:
        """All captures of a URL."""
        key, reader = surt_of(url), reader or Reader(self.places())
        return [parsed(read_range(*x[2:5])) for x in reader.captures((key, False, -math.inf), (key, True, math.inf))]


_open: dict = {}


def _raw(uri: str, offset: int, length: int) -> bytes:
    if uri not in _open:
        if len(_open) >= 64:
            for f in _open.values():
                f.close()
            _open.clear()
        fs, path = _fs(uri)
        _open[uri] = fs.open_input_file(path)
    return _open[uri].read_at(length, offset)


def read_range(uri: str, offset: int, length: int) -> bytes:
    return gzip.decompress(_raw(uri, offset, length))


def read_lines(uri: str, offset: int, length: int) -> list[list]:
    """Lines of a block or of a part of the directory: key, page id, file, offset, length."""
    return [json.loads(x) for x in zlib.decompress(_raw(uri, offset, length)).decode().splitlines()]


def revisits(spark: SparkSession, pages: DataFrame, id: str, html: str) -> DataFrame:
    """(_id, _digest, refers_to): payloads of LEAST_REVISIT bytes or more that equal that of a smaller id. Null ids: none."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    light = pages.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("_id"), F.unhex(F.sha2(payload, 256)).alias("_digest"), F.length(payload).alias("bytes"))
    light = light.filter(F.col("bytes") >= LEAST_REVISIT).select("_id", "_digest")
    classes = written(spark, light.groupBy("_digest").agg(F.min("_id").alias("refers_to"), F.max("_id").alias("last")).filter("last > refers_to").select("_digest", "refers_to"), "payload-classes")
    return light.join(classes, "_digest").filter("_id > refers_to").select("_id", "_digest", "refers_to").distinct()


def write_archives(spark: SparkSession, pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", path: str | None = None) -> Archive:
    """Writes every page as a record, and the index. File names are new for each task attempt: a lost attempt's file is
    named by no index line."""
    bounded_batches(spark)
    path = path or new_path(spark, "warc")
    rows = pages.select(F.col(id).cast("long").alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_html"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_html", 256)))
    rows = rows.join(revisits(spark, pages, id, html), ["_id", "_digest"], "left").withColumn("_key", surt("_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(path)
        fs.create_dir(top, recursive=True)
        name, out, at = "", None, 0
        for b in batches:
            lines = []
            for key, i, u, payload, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                member = gzip.compress(record(i, u, payload, ref), 4, mtime=0)
                out.write(member)
                lines.append((key, i, f"{path}/{name}", at, len(member)))
                at += len(member)
            columns = list(zip(*lines, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = rows.sortWithinPartitions("_key", "_id").select("_key", "_id", "_url", "_html", "refers_to").mapInArrow(write, "key string, id long, file string, offset long, length long")
    lines = written(spark, captures, "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(path)
        fs.create_dir(top, recursive=True)
        name, out, at, held = f"{uuid.uuid4().hex}.cdx.z", None, 0, []
        entries: list[tuple] = []

        def block():
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{top}/{name}", compression=None)
            data = zlib.compress("\n".join(map(json.dumps, held)).encode(), 6)
            out.write(data)
            entries.append((held[0][0], held[0][1], f"{path}/{name}", at, len(data), len(held)))
            at += len(data)
            held.clear()

        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(line)
                if len(held) == LINES:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            data, name = zlib.compress("\n".join(map(json.dumps, entries)).encode(), 6), f"{uuid.uuid4().hex}.dir.z"
            with fs.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(data)
            row = (*entries[0][:2], f"{path}/{name}", 0, len(data), len(entries))
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["first_key", "first_id", "file", "offset", "length", "blocks"])

    order = ["key", "id", "file", "offset"]
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "id", "file", "offset", "length")
    parts = written(spark, sorted_.mapInArrow(index, "first_key string, first_id long, file string, offset long, length long, blocks long"), "directory")
    dropped(spark, lines)
    return Archive(path, parts)


def read_captures(spark: SparkSession, archive: Archive, wanted: DataFrame) -> DataFrame:
    """Every capture of the keys and ids in wanted (key, id: distinct), looked up in the index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are those of the payload read; they are checked against its headers.
    """
    parts = spark.sparkContext.broadcast(archive.places())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        reader = Reader(parts.value)
        for b in batches:
            rows = []
            for at in map(place, *(c.to_pylist() for c in b.columns)):
                for _, id, file, offset, length in reader.captures(at, at):
                    h, payload = parsed(read_range(file, offset, length))
                    digest, n = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response" and (sha256(payload).hexdigest() != digest or len(payload) != n):
                        raise ValueError(f"damaged record of page {id} in {file} at {offset}")
                    rows.append((id, n, digest, h["warc-type"], int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = wanted.select("key", "id").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "id").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives and looks every page up in them again: one row for each row of pages. Ids are whole numbers.

    A null html is an empty payload, a null URL stands as urn:none; a null id is never a revisit nor referred to. Repeated
    rows (equal id and payload): each is a response or each a revisit; rows of one id with other payloads are told apart by payload. An empty table: no rows, no archive files.
    """
    archive = write_archives(spark, pages, id, url, html)
    return read_captures(spark, archive, pages.select(surt(url).alias("key"), F.col(id).cast("long").alias("id")).distinct())
