"""Binary files of change logs and sorted tables, as Spark data sources "kv_wal" and "kv_sst", with writers.

A log file is a run of frames: length (32 bits), CRC-32 of the body, a JSON body {op, key, value (base64), version}. A
frame whose header or body is short ends the file; a frame with a wrong checksum ends it too, and is reported in a last
row with an error. A body that isn't a record is skipped.

A table file is a data block of records (key length, key, value length, value, version, deleted), an index block of keys
and offsets, and a footer (index offset, index length, count, magic). Records are read up to the index's offset, never
into it. All numbers are big-endian.

A log file is a partition; a table file is one for every SPLIT bytes, whose tasks find their records in the index. Files are
read in pieces, not as a whole. Predicates on a table's key (equality, membership, comparisons, prefix), given as the
options start and end or pushed down with the option pushdown, are answered from the index: only records between the least
and the greatest key asked for are read.

Addresses: s3a and s3n are read as s3. A path without a scheme is the machine's own file system; write_files() and load()
give paths the scheme of Spark's default file system first, so on a cluster they never mean a private disk.
"""

from __future__ import annotations

import base64
import binascii
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from . import storage

# Fixed values of the table format: the footer's layout and magic number.
SST_MAGIC = 0x4F434B5653535442
SST_FOOTER = struct.Struct(">QIIQ")

WAL_SCHEMA = "op STRING, key STRING, value BINARY, version BIGINT, file STRING, position BIGINT, error STRING"
SST_SCHEMA = "key STRING, value BINARY, version BIGINT, deleted BOOLEAN, file STRING, position BIGINT"


#: Bytes of a table file that a task reads.
SPLIT = 64 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


class _Stream:
    """Sequential reads of a file through a buffer."""

    def __init__(self, f, start: int = 0, chunk: int = 1 << 20):
        self._f, self._chunk, self._data, self._at = f, chunk, b"", 0
        f.seek(start)
        self.position = start

    def take(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        while len(self._data) - self._at < n:
            more = self._f.read(max(self._chunk, n - (len(self._data) - self._at)))
            if not more:
                break
            self._data, self._at = self._data[self._at :] + more, 0
        out = self._data[self._at : self._at + n]
        self._at += len(out)
        self.position += len(out)
        return out


def encode_wal(records: list[dict]) -> bytes:
    """Frames of records (op, key, value bytes or None, version)."""
    out = bytearray()
    for r in records:
        fields = {"op": r["op"], "key": r["key"]}
        if r.get("value"):
            fields["value"] = base64.b64encode(r["value"]).decode()
        body = json.dumps(fields | {"version": r["version"]}, ensure_ascii=False, separators=(",", ":")).encode()
        out += struct.pack(">II", len(body), zlib.crc32(body)) + body
    return bytes(out)


def _wal_record(body: bytes) -> tuple | None:
    try:
        r = json.loads(body)
        op, key, version = r["op"], r["key"], int(r["version"])
        value = base64.b64decode(r.get("value") or "", validate=True)
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None
    if op not in ("put", "delete") or not isinstance(key, str):
        return None
    return op, key, value if op == "put" else None, version


def read_wal(f, name: str = "") -> Iterator[tuple]:
    stream = _Stream(f)
    while True:
        at = stream.position
        head = stream.take(8)
        if len(head) < 8:
            return
        size, crc = struct.unpack(">II", head)
        body = stream.take(size)
        if len(body) < size:
            return
        if zlib.crc32(body) != crc:
            yield None, None, None, None, name, at, "checksum mismatch"
            return
        if (r := _wal_record(body)) is not None:
            yield (*r, name, at, None)


def encode_sst(rows: list[dict]) -> bytes:
    """A table of state rows (key, value, version, deleted), which must be sorted by key."""
    keys = [r["key"].encode() for r in rows]
    if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
        raise ValueError("keys must rise")
    data, index = bytearray(), bytearray()
    for key, r in zip(keys, rows, strict=True):
        value = r.get("value") or b""
        index += struct.pack(">I", len(key)) + key + struct.pack(">Q", len(data))
        data += struct.pack(">I", len(key)) + key + struct.pack(">I", len(value)) + value + struct.pack(">Q", r["version"]) + bytes([bool(r.get("deleted"))])
    return bytes(data + index) + SST_FOOTER.pack(len(data), len(index), len(rows), SST_MAGIC)


class BadTable(ValueError):
    pass


def _footer(f, size: int, name: str) -> tuple[int, int, int]:
    """Where the data ends, the index's length, and the number of records."""
    if size < SST_FOOTER.size:
        raise BadTable(f"{name}: too short for a table")
    f.seek(size - SST_FOOTER.size)
    end, length, count, magic = SST_FOOTER.unpack(f.read(SST_FOOTER.size))
    if magic != SST_MAGIC or end > size - SST_FOOTER.size:
        raise BadTable(f"{name}: not a table")
    return end, length, count


def read_index(f, size: int, name: str = "") -> tuple[list[bytes], list[int], int]:
    """Keys and offsets of a table file's records, and where its data ends."""
    end, length, count = _footer(f, size, name)
    stream = _Stream(f, end)
    keys, offsets = [], []
    for _ in range(count):
        head = stream.take(4)
        key = stream.take(struct.unpack(">I", head)[0]) if len(head) == 4 else b""
        at = stream.take(8)
        if len(at) < 8 or stream.position > end + length:
            raise BadTable(f"{name}: the index has fewer than {count} entries")
        keys.append(key)
        offsets.append(struct.unpack(">Q", at)[0])
    return keys, offsets, end


def read_sst(f, size: int, name: str = "", start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """The records of a table file from one offset to another; raises BadTable if it isn't one or its records don't end where they should."""
    end, _, count = _footer(f, size, name)
    whole, stop = start == 0 and stop is None, end if stop is None else stop
    stream = _Stream(f, start)
    found = 0
    while stream.position < stop:
        at = stream.position
        key = stream.take(struct.unpack(">I", stream.take(4))[0])
        value = stream.take(struct.unpack(">I", stream.take(4))[0])
        tail = stream.take(9)
        if len(tail) < 9 or stream.position > stop:
            raise BadTable(f"{name}: the record at {at} crosses {stop}")
        version, deleted = struct.unpack(">Q?", tail)
        found += 1
        yield key.decode("utf-8"), None if deleted else value, version, deleted, name, at
    if whole and found != count:
        raise BadTable(f"{name}: {found} records, the footer says {count}")


class _File(InputPartition):
    """A file, or one part of several of it."""

    def __init__(self, path: str, size: int, part: int = 0, parts: int = 1):
        self.path, self.size, self.part, self.parts = path, size, part, parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str):
        self.path, self.suffix = options["path"], options.get("suffix", suffix)

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.is_file:
            return [_File(info.path, info.size)]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_File(x.path, x.size) for x in sorted(files, key=lambda x: x.path) if x.is_file and x.base_name.endswith(self.suffix)] or [_File("", 0)]

    def records(self, f, part: _File) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            fs, _ = _open(self.path)
            with fs.open_input_file(partition.path) as f:
                yield from self.records(f, partition)


class _WalReader(_Reader):
    def records(self, f, part: _File) -> Iterator[tuple]:
        return read_wal(f, part.path)


def after(prefix: str) -> str | None:
    """The least string behind all that start with the prefix; None if there is none."""
    last = prefix
    while last:
        code = ord(last[-1]) + 1
        code = 0xE000 if code == 0xD800 else code
        if code <= 0x10FFFF:
            return last[:-1] + chr(code)
        last = last[:-1]
    return None


class _SstReader(_Reader):
    def __init__(self, options: dict, suffix: str):
        super().__init__(options, suffix)
        self.start, self.end = options.get("start", ""), options.get("end") or None

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for x in super().partitions():
            parts = max(1, -(-x.size // SPLIT))
            out += [_File(x.path, x.size, i, parts) for i in range(parts)]
        return out

    def records(self, f, part: _File) -> Iterator[tuple]:
        if part.parts == 1 and not self.start and self.end is None:
            return read_sst(f, part.size, part.path)
        keys, offsets, end = read_index(f, part.size, part.path)
        lo = bisect_left(keys, self.start.encode())
        hi = len(keys) if self.end is None else bisect_left(keys, self.end.encode())
        # Of the part's share of the data, the records that begin in it.
        lo, hi = (max(lo, bisect_left(offsets, end * part.part // part.parts)), min(hi, bisect_left(offsets, end * (part.part + 1) // part.parts)))
        if lo >= hi:
            return iter(())
        return read_sst(f, part.size, part.path, offsets[lo], offsets[hi] if hi < len(offsets) else end)


class _PushedSstReader(_SstReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the range of keys by what it can, and leaves all filters to be applied exactly as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("key",):
                low = high = None
                if isinstance(f, EqualTo):
                    low, high = f.value, f.value + "\0"
                elif isinstance(f, In):
                    low, high = min(f.value), max(f.value) + "\0"
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = f.value
                elif isinstance(f, LessThan):
                    high = f.value
                elif isinstance(f, LessThanOrEqual):
                    high = f.value + "\0"
                elif isinstance(f, StringStartsWith):
                    low, high = f.value, after(f.value)
                if low is not None:
                    self.start = max(self.start, low, key=str.encode)
                if high is not None:
                    self.end = high if self.end is None else min(self.end, high, key=str.encode)
            yield f


class WalDataSource(DataSource):
    """spark.read.format("kv_wal").load(file or folder of *.log)"""

    @classmethod
    def name(cls) -> str:
        return "kv_wal"

    def schema(self) -> str:
        return WAL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WalReader(dict(self.options), ".log")


class SstDataSource(DataSource):
    """spark.read.format("kv_sst").load(file or folder of *.sst); options: start and end (keys), pushdown (true: takes filters on the key, which needs spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "kv_sst"

    def schema(self) -> str:
        return SST_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushedSstReader if options.get("pushdown", "").lower() == "true" else _SstReader)(options, ".sst")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalDataSource)
    spark.dataSource.register(SstDataSource)


def load(spark: SparkSession, kind: str, path: str, start: str = "", end: str = "") -> DataFrame:
    """The records of a file or folder; of tables those with start <= key < end, an empty end being none."""
    register(spark)
    return spark.read.format(kind).option("start", start).option("end", end).load(storage.qualified(spark, path))


def _write_files(rows: DataFrame, path: str, suffix: str, encode: Callable[[list[dict]], bytes]) -> list[str]:
    """A file for every partition that has rows; a task that is run again replaces what an earlier attempt left."""
    spark = rows.sparkSession
    target, names = storage.qualified(spark, path), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [dict(zip(names, values, strict=True)) for batch in batches for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        written = []
        if held:
            fs, root = _open(target)
            fs.create_dir(root, recursive=True)
            name = f"part-{TaskContext.get().partitionId():06d}{suffix}"
            with fs.open_output_stream(hidden := f"{root}/.{name}.{uuid.uuid4().hex}", compression=None) as out:
                out.write(encode(held))
            fs.move(hidden, f"{root}/{name}")
            written.append(name)
        yield pa.RecordBatch.from_pydict({"file": pa.array(written, pa.string())})

    return sorted(r.file for r in rows.mapInArrow(run, "file string").collect())


def write_sst(rows: DataFrame, path: str, partitions: int | None = None) -> list[str]:
    """Write state rows as table files of rising keys below path; returns their names. A file is held in memory, so partitions bounds it."""
    chosen = rows.select("key", "value", "version", "deleted")
    dealt = chosen.repartitionByRange(partitions, "key") if partitions else chosen.repartitionByRange("key")
    return _write_files(dealt.sortWithinPartitions("key"), path, ".sst", encode_sst)


def write_wal(cmds: DataFrame, path: str, partitions: int | None = None) -> list[str]:
    """Write commands as log files, in the order of versions over the files' names; returns the names."""
    chosen = cmds.select("version", "op", "key", "value")
    dealt = chosen.repartitionByRange(partitions, "version") if partitions else chosen.repartitionByRange("version")
    return _write_files(dealt.sortWithinPartitions("version"), path, ".log", encode_wal)


def recover(spark: SparkSession, path: str) -> DataFrame:
    """Commands of the readable part of a log's files. What a damaged file lacks shows in damage()."""
    rows = load(spark, "kv_wal", path)
    return rows.where("error IS NULL").selectExpr("version", "op", "key", "value", "CAST(NULL AS BIGINT) AS ttl_seconds")


def damage(spark: SparkSession, path: str) -> DataFrame:
    """file, position, error of log files that end in a damaged frame."""
    return load(spark, "kv_wal", path).where(F.col("error").isNotNull()).select("file", "position", "error")
