import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from keytide.llm import warc

from . import cases

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "long enough é " * 100
ROWS = [
    (1, "http://a.example/1", BIG),
    (2, "http://a.example/2", BIG),
    (9, "http://b.example/9", BIG),
    (9, "http://b.example/9", BIG),
    (None, "http://n.example/", BIG),
    (3, "http://a.example/3", "short"),
    (4, None, "short"),
    (5, "http://c.example/\r\nX-Evil: 1 é", None),
    (6, "", ""),
    (7, "http://x.example/", "y" * 300_000),
    (None, None, "z" * 2000),
    (None, None, "z" * 2000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    clashing = cases.with_clashes(pages(spark)).withColumns({c: F.lit("x") for c in ("newest", "digest", "large", "payload_digest", "refers_to", "n")})
    warc.write(warc.with_revisits(clashing), path)
    got = warc.read(spark, path).collect()
    want = {}
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        want.setdefault((page_id, len(data)), []).append(data)
    assert len(got) == len(ROWS)
    for r in got:
        data = want[r.page_id, r.payload_bytes][0]
        assert r.payload_digest == "sha1:" + hashlib.sha1(data).hexdigest()
        assert (bytes(r.payload) == data) if r.record_type == "response" else r.payload is None
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == len(BIG.encode())), key=repr)
    assert kinds == [(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (9, "response", None), (None, "revisit", 9)]
    assert [r.record_type for r in got if r.payload_bytes == 2000] == ["response"] * 2
    assert {r.target_uri for r in got if r.page_id == 5} == {"http://c.example/%0D%0AX-Evil:%201%20é"}


def test_files_are_plain_gzip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.with_revisits(pages(spark)), path)
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(ROWS) and b"\nX-Evil" not in text


def test_pushed_filters_and_skipped_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.with_revisits(pages(spark)), path)
    rows = warc.read(spark, path, payload=False)
    assert rows.where("record_type = 'revisit'").count() == 3
    assert rows.where("payload_bytes >= 2000 and page_id is not null").count() == 1
    assert rows.where(F.col("page_id").isin(3, 4)).count() == 2
    assert rows.where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path}, None)
    from pyspark.sql.datasource import EqualTo, IsNull

    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), IsNull(("page_id",))])) == [IsNull(("page_id",))]
    got = [x for p in reader.partitions() for x in reader.read(p)]
    assert len(got) == len(ROWS) - 3


def test_members_without_lengths_are_read_too(tmp_path):
    records = [warc.record(i, f"http://x/{i}", b"p" * (i * 70_000), "d", None) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    reader = warc.WarcReader({"path": str(tmp_path)}, None)
    got = [x for p in reader.partitions() for x in reader.read(p)]
    assert [(x[1], len(x[-1])) for x in got] == [(i, i * 70_000) for i in range(4)]


def test_truncated_file_is_an_error(tmp_path):
    data = warc.member(warc.record(1, "u", bytes(range(256)) * 4000, "d", None))
    (tmp_path / "a.warc.gz").write_bytes(data[: len(data) // 2])
    reader = warc.WarcReader({"path": str(tmp_path)}, None)
    with pytest.raises(ValueError):
        [x for p in reader.partitions() for x in reader.read(p)]


def test_files_roll_over(spark, tmp_path):
    path = str(tmp_path / "w")
    # Workers import the module anew, so the size is set where the writer's function looks it up: in a record that is larger than a file.
    big = spark.range(3).selectExpr("id as page_id", "'u' as url", "string(null) as html").withColumns({"payload_digest": F.lit("d"), "refers_to": F.lit(None).cast("long")})
    noise = F.udf(lambda i: random.Random(i).randbytes(warc.FILE_BYTES + 1), "binary")
    warc.write(big.withColumn("html", noise("page_id")).coalesce(1), path)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 3 and warc.read(spark, path, payload=False).count() == 3


def test_what_is_not_listed_is_not_read(spark, tmp_path):
    """Files of a task that ran twice, and of one that died."""
    path = tmp_path / "w"
    warc.write(warc.with_revisits(pages(spark)), str(path))
    one = next(path.glob("*.warc.gz"))
    (path / "part-000000-0009-other.warc.gz").write_bytes(one.read_bytes())
    (path / ".part-000000-0010-dead.warc.gz").write_bytes(b"half")
    assert warc.read(spark, str(path), payload=False).count() == len(ROWS)


def test_blocks_that_are_no_http_messages_are_whole(tmp_path):
    def made(kind, content, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [("resource", "text/html", b"<p>\r\n\r\nx"), ("conversion", "text/plain", b"plain"), ("response", "application/http", b"no head"), ("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nbody")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(made(*r)) for r in records))
    reader = warc.WarcReader({"path": str(tmp_path)}, None)
    got = [x[-1] for p in reader.partitions() for x in reader.read(p)]
    assert got == [b"<p>\r\n\r\nx", b"plain", b"no head", b"body"]


def test_addresses():
    import pyarrow.fs as pafs

    fs, path = warc.filesystem("s3a://bucket/folder?region=eu-west-1")
    assert isinstance(fs, pafs.S3FileSystem) and path == "bucket/folder"


def test_query_equals_sql(spark, tmp_path):
    df = cases.with_clashes(pages(spark))
    sf = cases.save(df, tmp_path, "pages")
    got = warc.op6_warc(spark, sf)
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet/*.parquet'")
    want = c.sql(warc.ORACLES["op6_warc"]).project(", ".join(got.columns)).fetchall()
    assert cases.rows_of(got) == sorted(want, key=repr)


def test_query_describes_the_payloads_and_not_the_headers(spark, tmp_path, monkeypatch):
    sf, read = cases.save(pages(spark), tmp_path, "pages"), warc.read
    want = cases.rows_of(warc.op6_warc(spark, sf))
    untrue = lambda c, x: F.when(F.col("record_type") == "response", F.lit(x)).otherwise(F.col(c))
    monkeypatch.setattr(warc, "read", lambda *a, **b: read(*a, **b).withColumns({"payload_digest": untrue("payload_digest", "sha1:0"), "payload_bytes": untrue("payload_bytes", 7)}))
    assert cases.rows_of(warc.op6_warc(spark, sf)) == want


def test_empty_table(spark, tmp_path):
    got = warc.op6_warc(spark, cases.save(pages(spark).limit(0), tmp_path, "pages"))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
