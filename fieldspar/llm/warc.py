"""WARC archives as a Python data source.

Reading plans byte ranges of files, applies predicates on record type and headers that Spark pushes
down, parses a record's headers from the first bytes of its gzip member, and goes on to the next
member without reading the payload of records that aren't wanted.  Members carry the ``sl`` extra
field with their compressed and plain lengths, which makes that jump possible; members without it,
from other writers, are inflated to find their end.

Writing gives each task a file of its own; the manifest, written at the commit, lists the files of
the attempts that counted, so a task that is run again after a loss leaves no doubled records.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from fieldspar.llm.storage import materialize, small_batches

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
MANIFEST = "_manifest.json"
RANGE_BYTES = 64 << 20
LEVEL = 3
#: Header of each column that predicates may be pushed down on.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}

# Fixed values of the formats: gzip member with an extra field, and the WARC version line.
_MAGIC = b"\x1f\x8b\x08\x04"
_VERSION = b"WARC/1.1\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def member(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers)
    plain = _VERSION + f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    fixed = 10 + 2 + 12 + 8
    extra = b"sl" + struct.pack("<HII", 8, len(body) + fixed, len(plain) & 0xFFFFFFFF)
    return _MAGIC + struct.pack("<IBBH", 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class _Blocks:
    """A file read in large blocks."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.at, self.data = offset, self.file.read_at(max(n, min(1 << 20, self.size - offset)), offset)
        return self.data[offset - self.at : offset - self.at + n]


def _skip_length(head: bytes) -> int:
    """The member's compressed length by its ``sl`` field, else 0."""
    if head[:4] == _MAGIC and len(head) >= 24 and head[12:16] == b"sl\x08\x00":
        return struct.unpack("<I", head[16:20])[0]
    return 0


def _headers(plain: bytes) -> tuple[dict[str, str], int]:
    """Headers by lower-case name and where the payload starts; an empty dict if they aren't complete."""
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return {}, 0
    lines = plain[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def records(blocks: _Blocks, start: int, stop: int, wanted: object, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records whose member starts in [start, stop), if their headers are wanted."""
    at = start
    if start:  # the first member that starts in the range
        while at < stop:
            data = blocks.get(at, 1 << 20)
            found = data.find(_MAGIC)
            if found < 0:
                at += max(1, len(data) - 3)
            elif _skip_length(blocks.get(at + found, 24)):
                at += found
                break
            else:
                at += found + 1
    while at < min(stop, blocks.size):
        length = _skip_length(blocks.get(at, 24))
        inflate = zlib.decompressobj(31)
        fed = 0
        plain, head, body = b"", {}, 0
        while not head and not inflate.eof:
            part = blocks.get(at + fed, 2048)
            if not part:
                break
            fed += len(part)
            plain += inflate.decompress(part)
            head, body = _headers(plain)
        want = bool(head) and wanted(head)
        need = int(head.get("content-length", 0)) if want and with_payload else 0
        if not length or need:
            pieces, have = [plain], len(plain)
            while not inflate.eof and not (length and have >= body + need):
                part = blocks.get(at + fed, 1 << 16)
                if not part:
                    break
                fed += len(part)
                more = inflate.decompress(part)
                have += len(more)
                if need:
                    pieces.append(more)
            plain = b"".join(pieces)
            length = length or fed - len(inflate.unused_data)
        if want:
            yield head, plain[body : body + need] if with_payload else None
        at += max(length, 1)


@dataclass
class FileRange(InputPartition):
    """Members of a file that start in [start, stop)."""

    path: str
    size: int
    start: int
    stop: int


class WarcReader(DataSourceReader):
    """Option ``payload``: ``bytes`` (default), ``none``, or ``verify`` for length and digest of the real payload without its bytes."""

    def __init__(self, path: str, mode: str) -> None:
        self.path, self.mode = path, mode
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith) and name != "warc-payload-digest":
                self.tests.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "set", None))
            else:
                yield f

    def wanted(self, head: dict[str, str]) -> bool:
        """Whether a record's headers pass all pushed predicates."""
        for name, kind, value in self.tests:
            own = head.get(name)
            if own is not None and name == "warc-payload-digest":
                own = own.removeprefix("sha256:")
            if own is None or (kind == "in" and own not in value) or (kind == "starts" and not own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[FileRange]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            files = [info]
        else:
            files = [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
            listed = f"{path}/{MANIFEST}"
            if system.get_file_info(listed).type == fs.FileType.File:
                with system.open_input_stream(listed) as f:
                    names = set(json.loads(f.read()))
                files = [x for x in files if x.path.rsplit("/", 1)[-1] in names]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            step = x.size
            if x.size > RANGE_BYTES:
                with system.open_input_file(x.path) as f:
                    step = RANGE_BYTES if _skip_length(f.read(24)) else x.size
            out += [FileRange(x.path, x.size, at, min(at + step, x.size)) for at in range(0, x.size, max(step, 1))]
        return out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows, size = [], 0
        with system.open_input_file(partition.path) as f:
            for head, payload in records(_Blocks(f, partition.size), partition.start, partition.stop, self.wanted, self.mode != "none"):
                kind, digest = head.get("warc-type"), head.get("warc-payload-digest")
                length = int(head.get("x-payload-length") or head.get("content-length", 0))
                digest = digest and digest.removeprefix("sha256:")
                if self.mode == "verify" and kind != "revisit":
                    length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                keep = payload if self.mode == "bytes" and kind != "revisit" else None
                rows.append((kind, head.get("warc-record-id"), head.get("warc-target-uri"), digest, head.get("warc-refers-to"), length, keep))
                size += len(keep or b"") + 256
                if size > 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    """A file that a task wrote, or none."""

    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA (without payload_bytes needed) to one file for each task."""

    def __init__(self, path: str, date: str, overwrite: bool) -> None:
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            columns = [batch.column(n).to_pylist() for n in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload")]
            for kind, id_, uri, digest, refers, length, payload in zip(*columns, strict=True):
                out = out or system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                headers = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Date", self.date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(length))]
                if uri is not None:
                    headers.append(("WARC-Target-URI", uri))
                if kind == "revisit":
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers)]
                out.write(member([*headers, ("Content-Type", "text/html; charset=utf-8")], payload or b""))
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        names = [m.name for m in messages if m and m.name]
        listed = f"{path}/{MANIFEST}"
        if not self.overwrite and system.get_file_info(listed).type == fs.FileType.File:
            with system.open_input_stream(listed) as f:
                names += json.loads(f.read())
        with system.open_output_stream(listed, compression=None) as f:
            f.write(json.dumps(sorted(names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """``format("warc")`` with a path; see WarcReader and WarcWriter for options."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "bytes"))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session and let it push predicates down."""
    small_batches(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: Repeated payloads up to this number (about 60 bytes each) are broadcast to the pages; more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
REVISIT_BYTES = 100
_ID = "<urn:fieldspar:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows to write: of equal payloads of at least REVISIT_BYTES bytes the smallest id is a response, others revisit it.

    Defined cases: a null html is empty; a null url has no target header; rows that share the
    smallest id are all responses; a null id is never referred to; other columns are ignored.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    repeats = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("payload_digest").alias("digest"), "first")
    repeats = materialize(repeats, "repeats")
    few = repeats.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(repeats) if few else repeats, F.col("payload_digest") == F.col("digest"), "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.lit(False))

    def name(c: str) -> F.Column:
        return F.concat(F.lit(_ID), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "target_uri", "payload_digest",
        F.when(again, name("first")).alias("refers_to"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def page_number(column: str) -> F.Column:
    """The page's id in a record's name."""
    return F.regexp_extract(column, r"page:(-?\d+)>", 1).try_cast("long")
