"""Sorted segments: writing, listing, choosing a tier, compaction, snapshots.

A segment is a folder of Parquet files, range-partitioned and sorted by key, with statistics and bloom filters on the key.
Segments hold state rows. A greater number is a newer segment, but versions decide.

Which folders make up the table is said by its manifest, a numbered record (sources/storage.py). Every write and
compaction goes to a folder of a new name, is published by the next manifest, and only then folders that neither of the
last KEEP manifests names are deleted. So whatever dies in between leaves the table as it was, and a reader keeps its
files until KEEP further manifests. The manifest also says how far the log has been applied (operators/progress.py): a
compaction of all segments drops a tombstone only up to the mark, as an older put of its key may still come behind it.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config, model
from ..sources import storage
from . import progress, state

TIER_SEGMENTS, TIER_RATIO = config.Config.tier_segments, config.Config.tier_ratio
#: Manifests whose folders stay.
KEEP = 2
_EMPTY = {"segments": {}, "noted": [], "mark": 0, "top": 0, "batch": -1, "compacted": -1}
_SEGMENT = "key STRING, value BINARY, version BIGINT, deleted BOOLEAN, segment_id BIGINT"


def manifest(spark: SparkSession, path: str) -> dict:
    """The table as it is: segments (number -> folder, bytes), noted versions, mark, top, last batch and last compacted batch."""
    found = storage.last_record(spark, f"{path}/_manifest")
    return found[1] | {"number": found[0]} if found else copy.deepcopy(_EMPTY) | {"number": -1}


def publish(spark: SparkSession, path: str, table: dict) -> None:
    """Make the table what the changed manifest says, then delete what the last KEEP manifests don't name."""
    number = table["number"] + 1
    storage.put_record(spark, f"{path}/_manifest", number, {k: v for k, v in table.items() if k != "number"})
    named: set[str] = set()
    for i in range(number - KEEP + 1, number + 1):
        if found := storage.last_record(spark, f"{path}/_manifest", i):
            named |= {x["folder"].split("/")[0] for x in found[1]["segments"].values()} | set(found[1]["noted"])
    for old in storage.record_numbers(spark, f"{path}/_manifest"):
        if old <= number - KEEP:
            storage.remove(spark, f"{path}/_manifest/{old:012d}.json")
    for folder in storage.names(spark, path):
        if folder.startswith(("run=", "_noted=")) and folder not in named:
            storage.remove(spark, f"{path}/{folder}")


def _write(rows: DataFrame, out: str, partitions: int | None, expected_keys: int | None, rows_per_file: int = 0) -> None:
    dealt = rows.select("key", "value", "version", "deleted")
    dealt = dealt.repartitionByRange(partitions, "key") if partitions else dealt.repartitionByRange("key")
    writer = dealt.sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("maxRecordsPerFile", rows_per_file)
    # Without a number of keys the writer fits its filters to those it meets.
    sized = ("parquet.bloom.filter.expected.ndv#key", expected_keys) if expected_keys else ("parquet.bloom.filter.adaptive.enabled", "true")
    writer.option(*sized).parquet(out)


def add_segment(rows: DataFrame, path: str, table: dict, segment_id: int, partitions: int | None = None, expected_keys: int | None = None, rows_per_file: int = 0) -> None:
    """Write state rows to a new folder and enter it into a manifest that is still to be published."""
    folder = f"run={uuid.uuid4().hex}/segment_id={segment_id}"
    _write(rows, f"{path}/{folder}", partitions, expected_keys, rows_per_file)
    table["segments"][str(segment_id)] = {"folder": folder, "bytes": storage.size(rows.sparkSession, f"{path}/{folder}")}


def write_segment(rows: DataFrame, path: str, segment_id: int, partitions: int | None = None, expected_keys: int | None = None) -> None:
    """Write state rows as a segment and publish it; writing the same number again replaces it."""
    table = manifest(rows.sparkSession, path)
    add_segment(rows, path, table, segment_id, partitions, expected_keys)
    publish(rows.sparkSession, path, table)


def read_segments(spark: SparkSession, path: str, ids: list[int] | None = None, table: dict | None = None) -> DataFrame:
    """The rows of all segments, or those of some numbers, with segment_id, which filters prune by folder."""
    known = (table or manifest(spark, path))["segments"]
    folders = [f"{path}/{x['folder']}" for i, x in sorted(known.items()) if ids is None or int(i) in ids]
    if not folders:
        return spark.createDataFrame([], _SEGMENT)
    return spark.read.schema(_SEGMENT).option("basePath", path).parquet(*folders).select("key", "value", "version", "deleted", "segment_id")


def merge_segments(segments: DataFrame) -> DataFrame:
    """State rows over segments: greatest version, and at equal versions the newest segment."""
    return state.latest(segments, order=[F.col("version").desc(), F.col("segment_id").desc()]).select("key", "value", "version", "deleted")


def segment_stats(segments: DataFrame) -> DataFrame:
    """Entries (tombstones included), tombstones, key range and bytes of each segment, newest first."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return (
        segments.groupBy("segment_id")
        .agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("deleted")).alias("tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(size).cast("long").alias("bytes"))
        .orderBy(F.desc("segment_id"))
    )


def select_tier(sizes: DataFrame, segments: int = TIER_SEGMENTS, ratio: int = TIER_RATIO) -> DataFrame:
    """Of (segment_id, bytes): the tier to compact, those within ratio times the smallest, or no rows if there are too few.

    The list of segments is metadata, a row a segment.
    """
    whole = W.partitionBy()
    tier = sizes.select("segment_id", "bytes").withColumn("smallest", F.greatest(F.min("bytes").over(whole), F.lit(1))).where(F.col("bytes") <= ratio * F.col("smallest"))
    return tier.withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("n") >= segments).select("segment_id", "bytes").orderBy("bytes", "segment_id")


def compact(segments: DataFrame, full: bool, mark: int | None = None) -> DataFrame:
    """The rows of the segment that replaces these. Only a compaction of all segments (full) may drop tombstones: in a part, they still hide older rows elsewhere. With a mark, only those up to it: behind it, older rows may still come."""
    merged = merge_segments(segments)
    if not full:
        return merged
    return merged.where(~F.col("deleted") if mark is None else ~F.col("deleted") | (F.col("version") > mark))


def compact_tier(spark: SparkSession, path: str, out_id: int, segments: int = TIER_SEGMENTS, ratio: int = TIER_RATIO, batch: int | None = None) -> list[int]:
    """Compact the tier that select_tier chooses by the manifest's sizes into segment out_id and publish it; returns the replaced segments. batch: noted in the manifest as compacted."""
    table = manifest(spark, path)
    sizes = [(int(i), x["bytes"]) for i, x in table["segments"].items() if int(i) != out_id]
    chosen = [r.segment_id for r in select_tier(spark.createDataFrame(sizes, "segment_id long, bytes long"), segments, ratio).collect()] if sizes else []
    changed = dict(table)
    if chosen:
        rows = read_segments(spark, path, chosen, table)
        changed["segments"] = {i: x for i, x in table["segments"].items() if int(i) not in chosen}
        add_segment(compact(rows, len(chosen) == len(table["segments"]), table["mark"]), path, changed, out_id)
    if batch is not None:
        changed["compacted"] = batch
    if chosen or batch is not None:
        publish(spark, path, changed)
    return chosen


def note_versions(spark: SparkSession, path: str, table: dict, versions: DataFrame) -> None:
    """Enter versions (column version), applied or declared gaps, into a manifest that is still to be published, and bring its mark up to date."""
    folder = f"_noted={uuid.uuid4().hex}"
    new = progress.blocks(versions)
    if table["noted"]:
        new = new.unionByName(spark.read.schema(progress.SCHEMA).parquet(*[f"{path}/{x}" for x in table["noted"]]))
    # What the mark covers isn't kept, so that the notes don't grow with the log.
    progress.united(new, table["mark"]).write.parquet(f"{path}/{folder}")
    table["noted"] = [folder]
    table["mark"] = progress.mark_of(spark.read.schema(progress.SCHEMA).parquet(f"{path}/{folder}"), table["mark"])


def declare_gaps(spark: SparkSession, path: str, versions: DataFrame) -> None:
    """Say that these versions (column version) will never come, so that the mark can pass them."""
    table = manifest(spark, path)
    note_versions(spark, path, table, versions)
    publish(spark, path, table)


def write_snapshot(cmds: DataFrame, path: str) -> int:
    """Write the live rows, sorted, and the greatest version beside them; returns that version."""
    top = cmds.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    rows = state.live(state.as_of(cmds, top))
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/rows")
    cmds.sparkSession.createDataFrame([(top,)], "max_version long").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return top


def keep_snapshots(cmds: DataFrame, path: str, threshold: int = config.Config.snapshot_threshold, retain: int = config.Config.snapshot_retain) -> int | None:
    """Write a snapshot below path when the log is threshold versions or more beyond the last one, delete all but the newest, and return its version; None if none is due. A snapshot counts from when its meta file is whole."""
    spark = cmds.sparkSession
    top = cmds.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    known = snapshots(spark, path)
    if top < (known[-1] if known else 0) + threshold:
        return None
    write_snapshot(state.as_of(cmds, top), f"{path}/version={top:020d}")
    for old in [*known, top][:-retain]:
        storage.remove(spark, f"{path}/version={old:020d}")
    return top


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Versions of the whole snapshots that keep_snapshots left, rising."""
    return [int(x.split("=")[1]) for x in storage.names(spark, path) if x.startswith("version=") and storage.exists(spark, f"{path}/{x}/meta/_SUCCESS")]


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.schema(model.LIVE).parquet(f"{path}/rows"), spark.read.schema("max_version long").json(f"{path}/meta").first()[0]


def snapshot_json(rows: DataFrame) -> DataFrame:
    """Live rows as the JSON objects of a snapshot file: Key, Value (base64), Version, Deleted."""
    from ..functions import scalars

    return rows.select(F.to_json(F.struct(F.col("key").alias("Key"), scalars.base64(F.col("value")).alias("Value"), F.col("version").alias("Version"), F.lit(False).alias("Deleted"))).alias("value"))


def read_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """Live rows of a snapshot file, one JSON array."""
    rows = spark.read.schema("Key STRING, Value STRING, Version BIGINT, Deleted BOOLEAN").option("multiLine", True).json(path)
    return rows.where(~F.coalesce("Deleted", F.lit(False))).select(F.col("Key").alias("key"), F.coalesce(F.unbase64("Value"), F.lit(b"")).alias("value"), F.col("Version").alias("version"))


def members(rows: DataFrame, column: str = "meta") -> DataFrame:
    """id, raft, grpc of cluster members from their JSON; what doesn't parse is skipped."""
    parsed = rows.select(F.from_json(column, "id STRING, raft STRING, grpc STRING").alias("m"))
    return parsed.where("m.id is not null").select("m.*")


def dump_json_array(rows: DataFrame) -> str:
    """A small snapshot as one JSON array, for exchange with tools; collects, so only for what fits the driver."""
    return json.dumps([json.loads(r.value) for r in snapshot_json(rows).collect()])
