import struct

import pytest

from keytide.operators import state
from keytide.sources import formats

from .model_log import SCHEMA, live, replay, sequence
from .model_log import rows as model_rows

RECORDS = [
    {"op": "put", "key": "a", "value": b"x\x00\xff", "version": 1},
    {"op": "put", "key": "é/b", "value": b"", "version": 2},
    {"op": "delete", "key": "a", "value": None, "version": 5},
]


def read(spark, path, kind="kv_wal"):
    formats.register(spark)
    return sorted(spark.read.format(kind).load(str(path)).collect(), key=lambda r: (r.file, r.position))


def test_wal(spark, tmp_path):
    data = formats.encode_wal(RECORDS)
    (tmp_path / "wal.log").write_bytes(data)
    got = [(r.op, r.key, None if r.value is None else bytes(r.value), r.version, r.error) for r in read(spark, tmp_path)]
    assert got == [("put", "a", b"x\x00\xff", 1, None), ("put", "é/b", b"", 2, None), ("delete", "a", None, 5, None)]
    assert formats.recover(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("cut", [1, 5, 9, 30])
def test_torn_wal(spark, tmp_path, cut):
    data = formats.encode_wal(RECORDS)
    (tmp_path / "wal.log").write_bytes(data[:-cut])
    assert [r.version for r in read(spark, tmp_path)] == [1, 2]


def test_flipped_bit_ends_the_log(spark, tmp_path):
    data = bytearray(formats.encode_wal(RECORDS))
    second = 8 + struct.unpack(">I", data[:4])[0]
    data[second + 12] ^= 1
    (tmp_path / "wal.log").write_bytes(data)
    got = read(spark, tmp_path)
    assert [(r.version, r.error, r.position) for r in got] == [(1, None, 0), (None, "checksum mismatch", second)]


def test_unreadable_body_is_skipped(spark, tmp_path):
    import zlib

    frame = lambda b: struct.pack(">II", len(b), zlib.crc32(b)) + b
    (tmp_path / "wal.log").write_bytes(frame(b"{") + frame(b'{"op":"merge","key":"a","version":1}') + frame(b"[]") + formats.encode_wal(RECORDS[:1]))
    assert [r.version for r in read(spark, tmp_path)] == [1]


ROWS = [{"key": "a", "value": b"1", "version": 3}, {"key": "b" * 300, "value": b"", "version": 4}, {"key": "c", "value": b"gone", "version": 9, "deleted": True}]


def test_sst(spark, tmp_path):
    (tmp_path / "1.sst").write_bytes(formats.encode_sst(ROWS))
    (tmp_path / "2.sst").write_bytes(formats.encode_sst([]))
    got = [(r.key, None if r.value is None else bytes(r.value), r.version, r.deleted) for r in read(spark, tmp_path, "kv_sst")]
    assert got == [("a", b"1", 3, False), ("b" * 300, b"", 4, False), ("c", None, 9, True)]


def test_bad_tables(tmp_path):
    good = formats.encode_sst(ROWS)
    for data in (b"", good[:-1], good[:-8] + b"\0" * 8, good[:10] + good[11:]):
        (tmp_path / "x.sst").write_bytes(data)
        with open(tmp_path / "x.sst", "rb") as f, pytest.raises((formats.BadTable, struct.error, UnicodeDecodeError)):
            list(formats.read_sst(f, len(data)))
    with pytest.raises(ValueError):
        formats.encode_sst(ROWS[::-1])


def test_small_reads(tmp_path):
    """Records that cross the buffer's end."""
    rows = [{"key": f"k{i:04d}", "value": bytes([i % 256]) * (i % 50), "version": i} for i in range(500)]
    (tmp_path / "x.sst").write_bytes(formats.encode_sst(rows))
    old = formats._Stream.__init__.__defaults__
    formats._Stream.__init__.__defaults__ = (0, 7)
    try:
        with open(tmp_path / "x.sst", "rb") as f:
            assert [(r[0], r[1], r[2]) for r in formats.read_sst(f, (tmp_path / "x.sst").stat().st_size)] == [(r["key"], r["value"], r["version"]) for r in rows]
    finally:
        formats._Stream.__init__.__defaults__ = old


def test_ranges_are_read_by_the_index(spark, tmp_path, monkeypatch):
    rows = [{"key": f"k{i:04d}/é", "value": bytes(i % 50), "version": i, "deleted": i % 7 == 0} for i in range(400)]
    data = formats.encode_sst(rows)
    (tmp_path / "x.sst").write_bytes(data)
    want = lambda lo, hi: [r["version"] for r in rows if lo <= r["key"] and (not hi or r["key"] < hi)]
    for lo, hi in (("", ""), ("k0100", "k0200"), ("k0399/é", ""), ("z", ""), ("", "a"), ("k0100", "k0100")):
        for split in (1 << 30, 1000):
            monkeypatch.setattr(formats, "SPLIT", split)
            reader = formats._SstReader({"path": str(tmp_path), "start": lo, "end": hi}, ".sst")
            assert sorted(r[2] for p in reader.partitions() for r in reader.read(p)) == want(lo, hi)
    taken: list = []
    whole = formats._Stream.take
    monkeypatch.setattr(formats._Stream, "take", lambda self, n: taken.append(n) or whole(self, n))
    reader = formats._SstReader({"path": str(tmp_path / "x.sst"), "start": "k0100/é", "end": "k0100/é\0"}, ".sst")
    monkeypatch.setattr(formats, "SPLIT", 1 << 30)
    assert [r[2] for p in reader.partitions() for r in reader.read(p)] == [100]
    assert len(taken) == 3 * len(rows) + 5  # the index, and one record


def test_pushed_filters_narrow_the_range(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, LessThanOrEqual, StringStartsWith

    def bounds(*filters):
        reader = formats._PushedSstReader({"path": str(tmp_path)}, ".sst")
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return reader.start, reader.end

    key = ("key",)
    assert bounds(EqualTo(key, "b")) == ("b", "b\0") and bounds(In(key, ("d", "b"))) == ("b", "d\0")
    assert bounds(GreaterThan(key, "b"), LessThan(key, "x"), LessThanOrEqual(key, "c")) == ("b", "c\0")
    assert bounds(StringStartsWith(key, "ab")) == ("ab", "ac") and bounds(EqualTo(("version",), 3)) == ("", None)
    assert formats.after("\ud7ff") == "\ue000" and formats.after("a\U0010ffff") == "b" and formats.after("\U0010ffff") is None


def test_written_files_come_back(spark, tmp_path):
    log = sequence(50)
    cmds = spark.createDataFrame(log, SCHEMA).repartition(3)
    assert formats.write_wal(cmds, str(tmp_path / "wal"), 2) and formats.damage(spark, str(tmp_path / "wal")).count() == 0
    assert model_rows(state.live(formats.recover(spark, str(tmp_path / "wal")))) == live(log)
    names = formats.write_sst(state.state(cmds), str(tmp_path / "sst"), 3)
    assert len(names) > 1
    found = formats.load(spark, "kv_sst", str(tmp_path / "sst"))
    assert {r.key: (None if r.value is None else bytes(r.value), r.version, r.deleted) for r in found.collect()} == replay(log)
    (tmp_path / "wal" / names[0].replace(".sst", ".log")).write_bytes(b"\0\0\0\1\0\0\0\0x")
    assert formats.damage(spark, str(tmp_path / "wal")).first().error == "checksum mismatch"


def test_addresses():
    with pytest.raises(Exception) as e:
        formats._open("nonsense://x/y")
    assert "nonsense" in str(e.value)
    import pyarrow.fs as pafs

    fs, path = formats._open("s3a://bucket/folder?region=eu-west-1")
    assert isinstance(fs, pafs.S3FileSystem) and path == "bucket/folder"
