"""The registered queries over the events table as a change log, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config, model
from ..functions import bloom, scalars
from ..operators import metrics, progress, reads, segments, state
from ..operators.consistency import KvReader
from ..sources import commands as source
from ..sources import formats, storage
from ..sources import log as stored_log
from ..streaming import watch

#: Versions of the events log that queries stop at or split on.
PAST, SNAPSHOT = 5000, 4000
PREFIX, START, END = "user:00010", "user:00010", "user:00013"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    op = F.when(F.col("event_type") == "error", F.lit(model.DELETE)).otherwise(F.lit(model.PUT))
    return source.commands(df, key, F.col("event_id") + 1, "props", op)


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A folder that is written at its first use in an application, and deleted when the driver ends."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written or not storage.exists(spark, f"{_written[key]}/_SUCCESS"):
        path = storage.shared_folder(spark, name)
        write(path)
        storage.remove_at_exit(spark, path)
        _written[key] = path
    return _written[key]


_written: dict[tuple[str, str, str], str] = {}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as commands: a user's key, an error deletes it, anything else puts its properties. They are stored once, in ranges of keys and sorted, so that reads of a key reach the files' statistics and bloom filters."""

    def write(path: str) -> None:
        dealt = _split(events(spark, sf_dir))[0].repartitionByRange("key").sortWithinPartitions("key", "version")
        dealt.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)

    return spark.read.schema(model.COMMANDS).parquet(_once(spark, sf_dir, "log", write))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string"))


def quarters(cmds: DataFrame) -> DataFrame:
    """State rows of four segments, dealt by version."""
    rows = cmds.select("key", "value", "version", (F.col("op") == model.DELETE).alias("deleted"), (F.col("version") % 4).alias("segment_id"))
    rank = F.row_number().over(W.partitionBy("segment_id", "key").orderBy(F.desc("version")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stored_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quarters() as four stored segments."""
    write = lambda path: quarters(log(spark, sf_dir)).write.mode("overwrite").partitionBy("segment_id").parquet(path)
    return spark.read.schema("key STRING, value BINARY, version BIGINT, deleted BOOLEAN, segment_id BIGINT").parquet(_once(spark, sf_dir, "quarters", write))


def _streamed(spark: SparkSession, cmds: DataFrame, start: Callable[[DataFrame, str], object], result: Callable[[str], DataFrame]) -> DataFrame:
    """Write the commands as files, run a stream over them, a file a batch, to the end, and read what it wrote."""
    home = storage.shared_folder(spark, "stream")
    # Dealt by a hash, so that files don't come in the order of versions.
    cmds.repartition(6, F.xxhash64("version")).write.mode("overwrite").parquet(f"{home}/log")
    storage.remove_at_exit(spark, home)
    query = start(watch.command_stream(spark, f"{home}/log", 1), home)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return result(home)


def _stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _streamed(
        spark,
        log(spark, sf_dir),
        lambda s, home: watch.segment_sink(s, f"{home}/segments", f"{home}/checkpoint", compact_every=2, settings=config.Config(tier_segments=2)),
        lambda home: segments.merge_segments(segments.read_segments(spark, f"{home}/segments")),
    )
    # Which tombstones the last compaction dropped depends on the sizes of its tier.
    return _shown(found.where(~F.col("deleted")).drop("deleted"))


def _stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(s: DataFrame, home: str):
        return watch.watch(s, PREFIX).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()

    return _shown(_streamed(spark, log(spark, sf_dir), start, lambda home: spark.read.schema(model.WATCH_EVENT).parquet(f"{home}/out")))


def _latest_deleted(cmds: DataFrame) -> DataFrame:
    return state.tombstones(cmds).agg(F.min("key").alias("key"))


def _layered(rows: DataFrame) -> DataFrame:
    return state.merge_layers([rows.where(F.col("segment_id") == i) for i in (3, 2, 1, 0)])


def _sizes(cmds: DataFrame) -> DataFrame:
    """Five segments, one of which is far larger."""
    part = F.col("version") % 100
    segment = F.when(part < 92, F.lit(0)).otherwise(F.floor((part - 92) / 2) + 1).cast("long")
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return cmds.groupBy(segment.alias("segment_id")).agg(F.sum(size).cast("long").alias("bytes"))


def _snapshot_plus_tail(cmds: DataFrame) -> DataFrame:
    return state.snapshot_plus_tail(state.live(state.as_of(cmds, SNAPSHOT)), SNAPSHOT, cmds)


def _bloom(spark: SparkSession, cmds: DataFrame) -> DataFrame:
    """How many of the absent and of the present keys a filter of the present ones lets through."""
    keys = cmds.select("key").distinct()
    absent = keys.select(F.concat(F.lit("absent-"), "key").alias("key"), F.lit(False).alias("present"))
    asked = keys.withColumn("present", F.lit(True)).unionByName(absent)
    told = bloom.probe(asked, bloom.build(keys))
    return told.groupBy("present").agg(F.count(F.lit(1)).alias("asked"), F.count_if("may_contain").alias("passed"))


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    key = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    op = F.when(F.col("event_type") == "error", F.lit("delete")).when(F.col("event_type") == "signup", F.lit("merge")).otherwise(F.lit("put"))
    return source.commands(df, key, F.col("event_id") + 1, "props", op)[1].select("version", "op", "key", "reason")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events appended to a log in two parts, in order; every rejected row has no version."""
    home = storage.shared_folder(spark, "appended")
    stored, rows = stored_log.Log(spark, f"{home}/log"), events(spark, sf_dir)
    key = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    op = F.when(F.col("event_type") == "error", F.lit(model.DELETE)).otherwise(F.lit(model.PUT))
    for part in (rows.where("event_id < 600"), rows.where("event_id >= 600")):
        stored.append(part, key, "props", op, order="event_id")
    storage.remove_at_exit(spark, home)
    return _shown(stored.read().select("version", "op", "key", "value"))


def _files(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Binary files written, then read back: a change log, or a table of which a range of keys is read by its index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home, cmds = storage.shared_folder(spark, kind), log(spark, sf_dir)
        if kind == "wal":
            formats.write_wal(cmds, f"{home}/files")
            found = formats.recover(spark, f"{home}/files").select("version", "op", "key", "value")
        else:
            formats.write_sst(state.state(cmds), f"{home}/files")
            start, end = (START, END) if kind == "sst_range" else ("", "")
            found = formats.load(spark, "kv_sst", f"{home}/files", start, end).select("key", "value", "version", "deleted")
        storage.remove_at_exit(spark, home)
        return _shown(found)

    return run


def _snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written with its version, read back, and followed by the rest of the log."""
    home, cmds = storage.shared_folder(spark, "snapshot"), log(spark, sf_dir)
    segments.keep_snapshots(state.as_of(cmds, SNAPSHOT), home, 1)
    storage.remove_at_exit(spark, home)
    rows, version = segments.read_snapshot(spark, f"{home}/version={segments.snapshots(spark, home)[-1]:020d}")
    return _shown(state.snapshot_plus_tail(rows, version, cmds))


def _barrier(cmds: DataFrame) -> DataFrame:
    """How far the log goes without the versions that are divisible by 7 from 1000 on, and with those declared as gaps."""
    some = cmds.where("version < 1000 or version % 7 <> 0")
    gaps = cmds.where("version >= 1000 and version % 7 = 0")
    found = [("held", progress.of_log(some)), ("declared", progress.of_log(some, gaps))]
    return cmds.sparkSession.createDataFrame([(name, x.mark, x.top) for name, x in found], "name string, mark long, top long")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    key = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    op = F.when(F.col("event_type") == "error", F.lit("delete")).when(F.col("event_type") == "signup", F.lit("merge")).otherwise(F.lit("put"))
    return metrics.statuses(*source.commands(df, key, F.col("event_id") + 1, "props", op))


def _sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(n, p) for n in (1, 10, 1000, 100_000) for p in (0.5, 0.01, 0.0001)]
    return spark.createDataFrame([(n, p, *bloom.size(n, p)) for n, p in cases], "n long, p double, m long, k long")


def _q(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(log(spark, sf_dir))


def _keys(spark: SparkSession, *keys: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


ASKED = ("user:000000", "user:000003", "user:000007", "user:000042", "user:000101", "user:999999")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kv_state": _q(lambda c: _shown(state.state(c))),
    "kv_state_aggregate": _q(lambda c: _shown(state.state(c, "aggregate"))),
    "kv_state_rejoin": _q(lambda c: _shown(state.state(c, "rejoin"))),
    "kv_live": _q(lambda c: _shown(state.live(c))),
    "snapshot_live": _q(lambda c: segments.snapshot_json(state.live(c))),
    "tombstones": _q(state.tombstones),
    "get_hit": _q(lambda c: _shown(reads.get(c, "user:000001"))),
    "get_deleted": _q(lambda c: _shown(reads.multi_get(c, _latest_deleted(c)))),
    "get_absent": _q(lambda c: _shown(reads.get(c, "user:999999"))),
    "multi_get": lambda spark, sf_dir: _shown(reads.multi_get(log(spark, sf_dir), _keys(spark, *ASKED))),
    "exists_semi": lambda spark, sf_dir: reads.exists(log(spark, sf_dir), _keys(spark, *ASKED)),
    "scan_all_limit": _q(lambda c: _shown(reads.scan_prefix(c, "", 100))),
    "scan_from": _q(lambda c: _shown(reads.scan_from(c, START))),
    "scan_range": _q(lambda c: _shown(reads.scan_range(c, START, END))),
    "scan_prefix": _q(lambda c: _shown(reads.scan_prefix(c, PREFIX))),
    "scan_prefix_limit": _q(lambda c: _shown(reads.scan_prefix(c, "user:0000", 25))),
    "scan_entries": _q(lambda c: _shown(reads.scan_entries(c, "user:0000", "user:00013"))),
    "scan_json": _q(lambda c: reads.as_json(reads.scan_prefix(c, PREFIX))),
    "scan_count": _q(lambda c: reads.scan_prefix(c, "user:0000").agg(F.count(F.lit(1)).alias("n"))),
    "state_as_of": _q(lambda c: _shown(state.live(state.as_of(c, PAST)))),
    "read_your_writes": _q(lambda c: _shown(_reader(c).scan("user:0000", 0, "read-your-writes", session_index=900))),
    "monotonic": _q(lambda c: _shown(_reader(c).get("user:000001", "monotonic", min_version=1000))),
    "strong": _q(lambda c: _shown(_reader(c).get("user:000002", "strong"))),
    "eventual": _q(lambda c: _shown(_reader(c).scan("user:0000", 10))),
    "watch_prefix": _q(lambda c: _shown(watch.watch(c, PREFIX))),
    "watch_puts": _q(lambda c: _shown(watch.watch(c, "user:0000").where("type = 'PUT'"))),
    "watch_deletes": _q(lambda c: _shown(watch.watch(c, "user:0000").where("type = 'DELETE'"))),
    "version_history": _q(lambda c: _shown(state.history(c))),
    "layered_merge": lambda spark, sf_dir: _shown(_layered(stored_quarters(spark, sf_dir))),
    "compaction_merge": lambda spark, sf_dir: _shown(segments.compact(stored_quarters(spark, sf_dir).where("segment_id < 2"), full=False)),
    "compaction_gc": lambda spark, sf_dir: _shown(segments.compact(stored_quarters(spark, sf_dir), full=True)),
    "compaction_gc_to_mark": lambda spark, sf_dir: _shown(segments.compact(stored_quarters(spark, sf_dir), full=True, mark=PAST)),
    "segment_stats": lambda spark, sf_dir: segments.segment_stats(stored_quarters(spark, sf_dir)),
    "segment_list": lambda spark, sf_dir: stored_quarters(spark, sf_dir).select("segment_id").distinct().orderBy(F.desc("segment_id")),
    "segment_difference": _q(lambda c: _sizes(c).join(segments.select_tier(_sizes(c)), "segment_id", "left_anti").select("segment_id")),
    "size_tier_select": _q(lambda c: segments.select_tier(_sizes(c))),
    "snapshot_plus_tail": _q(lambda c: _shown(_snapshot_plus_tail(c))),
    "memtable_size": _q(metrics.memtable_size),
    "command_json": _q(source.encode),
    "command_json_round_trip": _q(lambda c: _shown(source.decode(source.encode(c))[0].drop("ttl_seconds"))),
    "value_base64": _q(lambda c: c.where("op = 'put'").select("version", scalars.base64(F.col("value")).alias("value_base64"))),
    "crc32_values": _q(lambda c: c.where("op = 'put'").select("version", scalars.crc32(F.col("value")).alias("crc32"))),
    "fnv1a_keys": _q(lambda c: c.select("key").distinct().select("key", scalars.fnv1a64(F.col("key")).alias("fnv1a"))),
    "parse_limits": lambda spark, sf_dir: events(spark, sf_dir).groupBy(F.concat(F.when(F.col("user_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("")), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 1, F.lit("x")).otherwise(F.lit(""))).alias("given")).count().select("given", scalars.parse_long(F.col("given")).alias("parsed")),
    "bloom_negative": lambda spark, sf_dir: _bloom(spark, log(spark, sf_dir)),
    "mix64_keys": _q(lambda c: c.select("key").distinct().select("key", scalars.mix64(scalars.fnv1a64(F.col("key"))).alias("mixed"))),
    "bloom_positions": _q(lambda c: bloom.positions(c.select("key").distinct(), "key", 958506, 7).select("key", F.posexplode("positions").alias("i", "position"))),
    "bloom_sizing": _sizing,
    "log_append": _appended,
    "wal_files": _files("wal"),
    "sst_files": _files("sst"),
    "sst_range": _files("sst_range"),
    "snapshot_file": _snapshot_file,
    "barrier_mark": _q(_barrier),
    "op_counts": _q(metrics.op_counts),
    "op_status_counts": lambda spark, sf_dir: metrics.op_counts(_requests(spark, sf_dir), "op", "status"),
    "throughput": lambda spark, sf_dir: metrics.throughput(events(spark, sf_dir), "ts", ["event_type"]).select("event_type", "n", "seconds"),
    "latency_histogram": lambda spark, sf_dir: metrics.latency_histogram(events(spark, sf_dir), "value", ["event_type"], 0.05),
    "latency_percentiles": lambda spark, sf_dir: metrics.percentiles(events(spark, sf_dir), "value", [0.5, 0.95, 0.99, 1.0]),
    "status": _q(lambda c: metrics.status(c).drop("peers", "active_watchers")),
    "reject_invalid": _rejects,
    "stream_latest": _stream_latest,
    "stream_watch": _stream_watch,
}


def _reader(c: DataFrame):
    return KvReader(lambda: c)


_CMD = """cmd AS (SELECT event_id + 1 AS version, 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE coalesce(props, '') END AS value FROM events)"""
_RANK = "row_number() OVER (PARTITION BY key ORDER BY version DESC)"


def _with(rest: str) -> str:
    return f"WITH {_CMD},\n{rest}"


def _live(where: str = "true", source_where: str = "true") -> str:
    return _with(f"l AS (SELECT *, {_RANK} AS r FROM cmd WHERE {source_where})\nSELECT key, value, version FROM l WHERE r = 1 AND op = 'put' AND {where}")


def _state(source_where: str = "true", where: str = "true") -> str:
    return _with(f"l AS (SELECT *, {_RANK} AS r FROM cmd WHERE {source_where})\nSELECT key, value, version, op = 'delete' AS deleted FROM l WHERE r = 1 AND {where}")


def _get(keys: str) -> str:
    return _with(f"l AS (SELECT *, {_RANK} AS r FROM cmd), a AS ({keys})\nSELECT a.key, coalesce(l.op = 'put', false) AS found, l.value, l.version FROM a LEFT JOIN l ON l.key = a.key AND l.r = 1")


def _values(*keys: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in keys) + ") t(key)"


def _watch(where: str) -> str:
    return _with(f"w AS (SELECT CASE op WHEN 'put' THEN 'PUT' ELSE 'DELETE' END AS type, key, coalesce(value, '') AS value, version FROM cmd)\nSELECT * FROM w WHERE {where}")


_SIZES = """s AS (SELECT CAST(CASE WHEN version % 100 < 92 THEN 0 ELSE (version % 100 - 92) // 2 + 1 END AS BIGINT) AS segment_id,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM cmd GROUP BY 1),
t AS (SELECT *, min(bytes) OVER () AS smallest FROM s),
u AS (SELECT *, count(*) OVER () AS n FROM t WHERE bytes <= 10 * smallest)"""
_QUARTER = "q AS (SELECT *, version % 4 AS segment_id, row_number() OVER (PARTITION BY version % 4, key ORDER BY version DESC) AS o FROM cmd)"
_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
_U64 = "18446744073709551616::HUGEINT"
_SIGNED = lambda x: f"CAST(CASE WHEN {x} >= 9223372036854775808::HUGEINT THEN {x} - {_U64} ELSE {x} END AS BIGINT)"
# The finalizer; the product is taken in halves, as it would pass 128 bits.
_MIX = lambda x: f"""xor({_MULTIPLIED(f"xor({x}, {x} // 8589934592)")}, {_MULTIPLIED(f"xor({x}, {x} // 8589934592)")} // 8589934592)"""
_MULTIPLIED = lambda x: f"(((({x} // 4294967296) * {scalars.MIX_MULTIPLIER}::HUGEINT) % 4294967296 * 4294967296 + ({x} % 4294967296) * {scalars.MIX_MULTIPLIER}::HUGEINT) % {_U64})"
_POSITIONS = lambda keys, m, k: f"""h AS (SELECT key, {_FNV} AS a FROM ({keys})), g AS (SELECT key, a, {_MIX("a")} AS b FROM h),
p AS (SELECT key, i, CAST((a + i * b) % {_U64} % {m} AS BIGINT) AS position FROM g, (SELECT unnest(range(0, {k})) AS i))"""  # noqa: E731
_CRC = """t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, j: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc)"""
_PAYLOAD = """'{"t":' || CASE op WHEN 'put' THEN '0' ELSE '1' END || ',"k":"' || key || '"' ||
  CASE WHEN coalesce(strlen(value), 0) > 0 THEN ',"v":"' || to_base64(encode(value)) || '"' ELSE '' END || '}'"""

ORACLES: dict[str, str] = {
    "kv_state": _state(),
    "kv_state_aggregate": _state(),
    "kv_state_rejoin": _state(),
    "kv_live": _live(),
    "snapshot_live": _with(
        f"""l AS (SELECT *, {_RANK} AS r FROM cmd)
SELECT '{{"Key":"' || key || '","Value":"' || to_base64(encode(value)) || '","Version":' || version || ',"Deleted":false}}' AS value FROM l WHERE r = 1 AND op = 'put'"""
    ),
    "tombstones": _with(f"l AS (SELECT *, {_RANK} AS r FROM cmd)\nSELECT key, version FROM l WHERE r = 1 AND op = 'delete'"),
    "get_hit": _get(_values("user:000001")),
    "get_deleted": _get("SELECT min(key) AS key FROM l WHERE r = 1 AND op = 'delete'"),
    "get_absent": _get(_values("user:999999")),
    "multi_get": _get(_values(*ASKED)),
    "exists_semi": _with(f"l AS (SELECT *, {_RANK} AS r FROM cmd)\nSELECT key FROM l WHERE r = 1 AND op = 'put' AND key IN ({', '.join(repr(k) for k in ASKED)})"),
    "scan_all_limit": _live() + " ORDER BY key LIMIT 100",
    "scan_from": _live(f"key >= '{START}'"),
    "scan_range": _live(f"key >= '{START}' AND key < '{END}'"),
    "scan_prefix": _live(f"starts_with(key, '{PREFIX}')"),
    "scan_prefix_limit": _live("starts_with(key, 'user:0000')") + " ORDER BY key LIMIT 25",
    "state_as_of": _live(source_where=f"version <= {PAST}"),
    "read_your_writes": _live("starts_with(key, 'user:0000')"),
    "monotonic": _get(_values("user:000001")),
    "strong": _get(_values("user:000002")),
    "eventual": _live("starts_with(key, 'user:0000')") + " ORDER BY key LIMIT 10",
    "watch_prefix": _watch(f"starts_with(key, '{PREFIX}')"),
    "watch_puts": _watch("starts_with(key, 'user:0000') AND type = 'PUT'"),
    "watch_deletes": _watch("starts_with(key, 'user:0000') AND type = 'DELETE'"),
    "version_history": _with(
        """h AS (SELECT key, version, op, value, row_number() OVER w AS revision, lag(version) OVER w AS previous_version, lead(version) OVER w AS next_version
  FROM cmd WINDOW w AS (PARTITION BY key ORDER BY version))
SELECT * FROM h"""
    ),
    "scan_entries": _state(where="key >= 'user:0000' AND key < 'user:00013'"),
    "scan_json": _with(
        f"""l AS (SELECT *, {_RANK} AS r FROM cmd)
SELECT key, '{{"key":"' || key || '","value":"' || to_base64(encode(value)) || '","version":' || version || '}}' AS json FROM l WHERE r = 1 AND op = 'put' AND starts_with(key, '{PREFIX}')"""
    ),
    "scan_count": _with(f"l AS (SELECT *, {_RANK} AS r FROM cmd)\nSELECT count(*) AS n FROM l WHERE r = 1 AND op = 'put' AND starts_with(key, 'user:0000')"),
    "layered_merge": _state(),
    "compaction_merge": _state("version % 4 < 2"),
    "compaction_gc": _state(where="op = 'put'"),
    "compaction_gc_to_mark": _state(where=f"(op = 'put' OR version > {PAST})"),
    "segment_stats": _with(
        f"""{_QUARTER}
SELECT segment_id, count(*) AS entries, count(*) FILTER (op = 'delete') AS tombstones, min(key) AS min_key, max(key) AS max_key,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM q WHERE o = 1 GROUP BY segment_id"""
    ),
    "segment_list": _with("q AS (SELECT DISTINCT version % 4 AS segment_id FROM cmd)\nSELECT segment_id FROM q"),
    "segment_difference": _with(f"{_SIZES}\nSELECT segment_id FROM s WHERE segment_id NOT IN (SELECT segment_id FROM u WHERE n >= 4)"),
    "size_tier_select": _with(f"{_SIZES}\nSELECT segment_id, bytes FROM u WHERE n >= 4"),
    "snapshot_plus_tail": _live(),
    "memtable_size": _with(
        """f AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY version) AS r FROM cmd)
SELECT count(*) AS keys, CAST(coalesce(sum(strlen(key) + coalesce(strlen(value), 0) + 24), 0) AS BIGINT) AS bytes FROM f WHERE r = 1"""
    ),
    "command_json": _with(f"p AS (SELECT version, {_PAYLOAD} AS payload FROM cmd)\nSELECT * FROM p"),
    "command_json_round_trip": _with("p AS (SELECT version, op, key, value FROM cmd)\nSELECT * FROM p"),
    "value_base64": _with("p AS (SELECT version, to_base64(encode(value)) AS value_base64 FROM cmd WHERE op = 'put')\nSELECT * FROM p"),
    "fnv1a_keys": _with(
        f"""k AS (SELECT DISTINCT key FROM cmd), h AS (SELECT key, {_FNV} AS x FROM k)
SELECT key, CAST(CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END AS BIGINT) AS fnv1a FROM h"""
    ),
    "parse_limits": """WITH g AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN ' ' ELSE '' END || CAST(user_id AS VARCHAR) || CASE WHEN user_id % 3 = 1 THEN 'x' ELSE '' END AS given FROM events)
SELECT given, CASE WHEN regexp_full_match(given, '[+-]?[0-9]+') THEN coalesce(TRY_CAST(given AS BIGINT), 0) ELSE 0 END AS parsed FROM g""",
    "crc32_values": _with(
        f"""{_CRC}, v AS (SELECT version, [ascii(value[i])::BIGINT FOR i IN range(1, strlen(value) + 1)] AS b FROM cmd WHERE op = 'put')
SELECT version, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t.crc[1 + xor(c % 256, x)])), 4294967295::BIGINT) AS BIGINT) AS crc32 FROM v, t"""
    ),
    "bloom_negative": _with(
        f"""k AS (SELECT DISTINCT key FROM cmd), n AS (SELECT CAST(ceil(-count(*) * ln(0.01) / ln(2) ** 2) AS BIGINT) AS m, count(*) AS n FROM k),
s AS (SELECT m, greatest(1, CAST(round(m / n * ln(2)) AS BIGINT)) AS k FROM n),
asked AS (SELECT key, true AS present FROM k UNION ALL SELECT 'absent-' || key, false FROM k),
{_POSITIONS("SELECT key FROM asked", "(SELECT m FROM s)", "(SELECT k FROM s)")},
bits AS (SELECT DISTINCT position FROM p JOIN k USING (key)),
told AS (SELECT p.key, bool_and(bits.position IS NOT NULL) AS passed FROM p LEFT JOIN bits ON p.position = bits.position GROUP BY p.key)
SELECT present, count(*) AS asked, count(*) FILTER (passed) AS passed FROM asked JOIN told USING (key) GROUP BY present"""
    ),
    "mix64_keys": _with(f"h AS (SELECT key, {_FNV} AS a FROM (SELECT DISTINCT key FROM cmd)), g AS (SELECT key, {_MIX('a')} AS x FROM h)\nSELECT key, {_SIGNED('x')} AS mixed FROM g"),
    "bloom_positions": _with(f"{_POSITIONS('SELECT DISTINCT key FROM cmd', '958506', '7')}\nSELECT key, CAST(i AS INTEGER) AS i, position FROM p"),
    "bloom_sizing": """WITH c AS (SELECT n::BIGINT AS n, p::DOUBLE AS p FROM (SELECT unnest([1, 10, 1000, 100000]) AS n) a, (SELECT unnest([0.5, 0.01, 0.0001]) AS p) b),
s AS (SELECT n, p, CAST(ceil(-n * ln(p) / ln(2) ** 2) AS BIGINT) AS m FROM c)
SELECT n, p, m, greatest(1, CAST(round(m / n * ln(2)) AS BIGINT)) AS k FROM s""",
    "log_append": """WITH c AS (SELECT row_number() OVER (ORDER BY event_id) AS version, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  'user:' || CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN NULL ELSE coalesce(props, '') END AS value FROM events WHERE user_id % 10 <> 0)
SELECT version, op, key, value FROM c""",
    "wal_files": _with("p AS (SELECT version, op, key, value FROM cmd)\nSELECT * FROM p"),
    "sst_files": _state(),
    "sst_range": _state(where=f"key >= '{START}' AND key < '{END}'"),
    "snapshot_file": _live(),
    "barrier_mark": _with(
        """s AS (SELECT version FROM cmd WHERE version < 1000 OR version % 7 <> 0), t AS (SELECT max(version) AS top FROM s), a AS (SELECT max(version) AS all_top FROM cmd),
o AS (SELECT 'held' AS name, coalesce((SELECT min(version) FROM cmd WHERE version >= 1000 AND version % 7 = 0) - 1, all_top) AS mark FROM a
  UNION ALL SELECT 'declared', all_top FROM a)
SELECT o.name, o.mark, t.top FROM o, t"""
    ),
    "op_status_counts": """WITH c AS (SELECT CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'merge' ELSE 'put' END AS op, user_id % 10 = 0 AS empty FROM events)
SELECT op, CASE WHEN empty THEN 'empty key' WHEN op = 'merge' THEN 'unknown operation' ELSE 'ok' END AS status, count(*) AS n FROM c GROUP BY 1, 2""",
    "throughput": "SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY event_type",
    "op_counts": _with("o AS (SELECT op, count(*) AS n FROM cmd GROUP BY op)\nSELECT * FROM o"),
    "latency_histogram": """WITH b AS (SELECT 0.05::DOUBLE * pow(2::DOUBLE, i) AS le FROM range(14) t(i) UNION ALL SELECT 'Infinity'::DOUBLE),
t AS (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS sum, count(*) AS count FROM events GROUP BY event_type)
SELECT t.event_type, b.le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value <= b.le) AS cumulative, t.sum, t.count FROM t, b""",
    "latency_percentiles": """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events),
p AS (SELECT unnest([0.5, 0.95, 0.99, 1.0])::DOUBLE AS p)
SELECT p.p, s.value, s.n FROM s JOIN p ON s.place = least(CAST(floor(s.n * p.p) AS BIGINT), s.n - 1)""",
    "status": _with(
        f"""l AS (SELECT *, {_RANK} AS r FROM cmd)
SELECT 'local' AS node_id, 'local' AS leader, 'Leader' AS state, 0::BIGINT AS term, max(version) AS commit_index, max(version) AS applied_index, max(version) > 0 AS ready,
  count(*) FILTER (r = 1) AS keys, count(*) FILTER (r = 1 AND op = 'put') AS live_keys FROM l"""
    ),
    "reject_invalid": """WITH c AS (SELECT event_id + 1 AS version, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'merge' ELSE 'put' END AS op,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 'user:' || CAST(user_id AS VARCHAR) END AS key FROM events)
SELECT version, op, key, CASE WHEN key = '' THEN 'empty key' ELSE 'unknown operation' END AS reason FROM c WHERE key = '' OR op = 'merge'""",
    "stream_latest": _live(),
    "stream_watch": _watch(f"starts_with(key, '{PREFIX}')"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest live values under a prefix that every scale has."""
    return _shown(reads.scan_prefix(log(spark, sf_dir), "user:0000"))
