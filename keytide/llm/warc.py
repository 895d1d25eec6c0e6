"""WARC archives: a writer for tables of pages, and a Spark data source "warc" that reads archives back.

Files are WARC/1.1, one gzip member a record. Each member's gzip header has an extra field "sl" with the member's
compressed length, so that a reader which has seen a record's headers can go on to the next record without inflating the
payload. Archives without that field are read as well, by inflating to the end of each member.

A writer's files count once Spark has committed the list of them, so tasks that ran twice or died leave nothing that is
read; a folder without such a list is read whole. The source plans its partitions from file sizes (small files together, a
file is never split because only the writer knows where members start), takes equality, membership and comparison predicates on the record type and the other
headers out of Spark's hands, parses a record's headers first, and inflates a payload only if the record passes and
payloads are wanted (option payload=true).

Addresses with s3a or s3n are read as s3; read() and write() give a path without a scheme that of Spark's file system.

Defined cases: a null payload is an empty one; a very long one is a record like any other, which its task holds in
memory; a column payload_digest or refers_to of the table is replaced by the writer's; a null id is written without the header and is read as null, and such a
record never has others refer to it while a record with an id has the same payload; records that repeat the largest id
are all responses; control characters and spaces in a target address are percent-encoded; an empty table gives no files
and no rows; further columns play no part.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..sources import storage
from . import common

#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 1000
#: A writer starts another file beyond so many bytes, a reader packs small files into a partition up to so many, and reads so many at a time.
FILE_BYTES, PART_BYTES, READ_BYTES = 64 << 20, 8 << 20, 1 << 18
#: The list of a writer's files.
LISTED = "_files"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _header_value(value: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the response with the page id refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = uuid.uuid5(_NAMESPACE, f"{page_id}/{url}/{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" has its own length and the data's (32 bits each)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head, tail = 10 + 2 + 12, 8
    extra = b"sl" + struct.pack("<HII", 8, head + len(body) + tail & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", refers_col: str = "refers_to", digest_col: str = "payload_digest") -> None:
    """Write a record a row below path. A file has a name of its own attempt, is moved when it is whole, and counts when the list of files is committed."""
    common.bound_batches(pages.sparkSession)
    target = storage.qualified(pages.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(target)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, names, sizes = None, [], []

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{root}/.{names[-1]}", f"{root}/{names[-1]}")

        for batch in common.cut(batches):
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or sizes[-1] >= FILE_BYTES:
                    close()
                    names.append(f"part-{part:06d}-{len(names):04d}-{attempt}.warc.gz")
                    sizes.append(0)
                    out = fs.open_output_stream(f"{root}/.{names[-1]}", compression=None)
                data = member(record(page_id, url, payload, digest, refers_to))
                out.write(data)
                sizes[-1] += len(data)
        close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")), F.col(digest_col), F.col(refers_col).cast("long"))
    rows.toDF("a", "b", "c", "d", "e").mapInArrow(run, "file string, bytes long").write.parquet(f"{target}/{LISTED}")


class _Chunks:
    """Reads of a file at any place, a chunk at a time; what the last chunk holds isn't read again."""

    def __init__(self, stream):
        self._stream, self._at, self._data = stream, 0, b""

    def read(self, at: int, size: int) -> bytes:
        """Up to size bytes from at: fewer only at the end of the file."""
        skip = at - self._at
        if not (0 <= skip and skip + size <= len(self._data)):
            self._stream.seek(at)
            self._at, self._data, skip = at, self._stream.read(max(size, READ_BYTES)), 0
        return self._data[skip : skip + size]


class _Member:
    """A record in an open file: inflates no more than it is asked for."""

    def __init__(self, chunks: _Chunks, at: int):
        self._chunks, self._at, self._next = chunks, at, None
        data = chunks.read(at, 1 << 12)
        self.empty = not data
        self._read = len(data)
        if data[:2] == b"\x1f\x8b" and len(data) >= 24 and data[3] & 4 and data[12:14] == b"sl":
            length = struct.unpack_from("<I", data, 16)[0]
            self._next = at + length if length else None
        self._inflate = zlib.decompressobj(31)
        self._buffer = self._inflate.decompress(data, 1 << 13) if data else b""

    def _more(self) -> bool:
        if self._inflate.eof:
            return False
        data = self._inflate.unconsumed_tail
        if not data:
            data = self._chunks.read(self._at + self._read, 1 << 16)
            self._read += len(data)
            if not data:
                raise ValueError(f"the gzip member at {self._at} has no end")
        self._buffer += self._inflate.decompress(data, 1 << 18)
        return True

    def headers(self) -> dict[str, str]:
        while (end := self._buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError(f"the record at {self._at} has no headers")
        lines = self._buffer[:end].decode("utf-8").split("\r\n")
        self._buffer = self._buffer[end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {self._at}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def block(self, length: int) -> bytes:
        out = io.BytesIO()
        while True:
            out.write(self._buffer)
            self._buffer = b""
            if out.tell() >= length or not self._more():
                return out.getvalue()[:length]

    def next(self) -> int:
        """Where the next member starts: known from the extra field, or found by inflating the rest."""
        if self._next is None:
            while not self._inflate.eof:
                self._buffer = b""
                self._more()
            self._next = self._at + self._read - len(self._inflate.unused_data)
        return self._next


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _column(filter: Filter) -> str | None:
    name = getattr(filter, "attribute", ())
    return name[0] if len(name) == 1 and name[0] not in ("payload",) else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.schema, self.filters = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and _column(f):
                self.filters.append((type(f).__name__, _column(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((x.size, x.path) for x in found if x.is_file and not x.base_name.startswith((".", "_")))
        if any(x.base_name == LISTED for x in found):
            lists = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/{LISTED}")) if x.base_name.endswith(".parquet")]
            listed = [t for x in lists for t in parquet.read_table(x, filesystem=fs).to_pylist()]
            files = sorted((x["bytes"], f"{root}/{x['file']}") for x in listed)
        parts: list[list[str]] = []
        room = 0
        for size, name in files:
            if size > room:
                parts.append([])
                room = PART_BYTES
            parts[-1].append(name)
            room -= size
        return [_Files(x) for x in parts] or [_Files([])]

    def passes(self, row: dict) -> bool:
        for kind, name, value in self.filters:
            x = row[name]
            if x is None:
                return False
            ok = {"EqualTo": lambda: x == value, "In": lambda: x in value, "GreaterThan": lambda: x > value, "GreaterThanOrEqual": lambda: x >= value, "LessThan": lambda: x < value, "LessThanOrEqual": lambda: x <= value}[kind]()
            if not ok:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        number = lambda x: None if x is None else int(x)
        for name in partition.files:
            with fs.open_input_file(name) as stream:
                at, chunks = 0, _Chunks(stream)
                while not (found := _Member(chunks, at)).empty:
                    h = found.headers()
                    row = {"record_type": h.get("warc-type"), "page_id": number(h.get("x-page-id")), "target_uri": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest"), "payload_bytes": number(h.get("x-payload-length")), "refers_to": number(h.get("x-refers-to-page-id"))}
                    if self.passes(row):
                        payload = None
                        # A revisit's block has no payload; what isn't an HTTP message is one as a whole.
                        if self.payload and row["record_type"] != "revisit":
                            payload = found.block(int(h["content-length"]))
                            if h.get("content-type", "").startswith("application/http") and (end := payload.find(b"\r\n\r\n")) >= 0:
                                payload = payload[end + 4 :]
                        yield (*row.values(), payload)
                    at = found.next()


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder); option: payload (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive. Filters are pushed to the source, which Spark allows by a setting of the session that this makes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(storage.qualified(spark, path))


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload_digest and refers_to: of the rows with equal payloads of at least so many bytes, the largest id, for the others.

    The largest ids are found by an aggregate over ids and digests alone, and only digests that several rows have meet
    the pages again, in a join whose hot digests Spark can split.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(row, F.col(f"`{id_col}`").alias("id"), F.sha1(payload).alias("digest"), (F.octet_length(payload) >= least).alias("large"))
    newest = rows.where("large").groupBy("digest").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = rows.join(newest, "digest", "left")
    older = F.col("id").isNull() | (F.col("id") < F.col("newest"))
    kept = [F.col(f"row.`{c}`") for c in pages.columns if c not in ("payload_digest", "refers_to")]
    return met.select(*kept, F.col("digest").alias("payload_digest"), F.when(older, F.col("newest")).alias("refers_to"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read the archives back; a response is described by its payload, a revisit by its headers."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = common.new_shared_path(spark, "warc")
    write(with_revisits(pages), path)
    storage.remove_at_exit(spark, path)
    found = read(spark, path)
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS newest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN newest IS NOT NULL AND (page_id IS NULL OR page_id < newest) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < newest THEN newest END AS refers_to
FROM m""",
}
