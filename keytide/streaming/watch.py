"""Change subscriptions and incremental state over a stream of commands.

A watch is lossless and resumes from its checkpoint. Sources deliver in their own order, so within a micro-batch events
are sorted by version where order matters (foreachBatch); state is unaffected, as it is reduced by version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config, model
from ..operators import progress, segments, state


def watch(cmds: DataFrame, prefix: str = "") -> DataFrame:
    """type, key, value, version of each command whose key starts with the prefix; batch or stream. Deletes, of absent keys as well, are events with an empty value."""
    rows = cmds.where(F.col("key").startswith(prefix)) if prefix else cmds
    deleted = F.col("op") == model.DELETE
    return rows.select(F.when(deleted, F.lit("DELETE")).otherwise(F.lit("PUT")).alias("type"), "key", F.when(deleted, F.lit(b"")).otherwise(F.col("value")).alias("value"), "version")


def subscribe(cmds: DataFrame, prefix: str, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a watch that gives each micro-batch's events, in version order, to handle; stop() it to unsubscribe."""
    return (
        watch(cmds, prefix)
        .writeStream.foreachBatch(lambda batch, i: handle(batch.orderBy("version"), i))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def command_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of commands from a folder of Parquet files."""
    reader = spark.readStream.schema(model.COMMANDS)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def latest_stream(cmds: DataFrame) -> DataFrame:
    """key, value, version, deleted as a running aggregate, for update or complete mode."""
    rows = cmds.select("key", "value", "version", (F.col("op") == model.DELETE).alias("deleted"))
    top = rows.groupBy("key").agg(F.max_by(F.struct("value", "version", "deleted"), "version").alias("row"))
    return top.select("key", F.when(~F.col("row.deleted"), F.col("row.value")).alias("value"), "row.version", "row.deleted")


def changes_stream(cmds: DataFrame) -> DataFrame:
    """Like latest_stream, but emits only keys whose version rose, with the version it replaces: custom state, a version a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get[0] if held.exists else None
        best = None
        for f in frames:
            row = f.loc[f["version"].idxmax()]
            if best is None or row["version"] > best["version"]:
                best = row
        if best is not None and (before is None or best["version"] > before):
            held.update((int(best["version"]),))
            deleted = best["op"] == model.DELETE
            yield pd.DataFrame({"key": [key[0]], "value": [None if deleted else best["value"]], "version": [int(best["version"])], "deleted": [deleted], "replaced": pd.Series([before], dtype="Int64")})

    rows = cmds.select("key", "op", "value", "version")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, value binary, version long, deleted boolean, replaced long", "version long", "append", GroupStateTimeout.NoTimeout)


def segment_sink(cmds: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int | None = 0, settings: config.Config = config.Config()) -> StreamingQuery:
    """Write each micro-batch's latest rows as a segment and note its versions, in one manifest, so that they count once.

    A repeated batch that the manifest already has is skipped: its rows may have been compacted since. With
    compact_every (None: as the settings say), every so many batches a chosen tier becomes a segment, which the manifest notes as well. settings: bounds
    of a segment's files and of a tier.
    """

    every = settings.compaction_batches if compact_every is None else compact_every

    def write(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        table = segments.manifest(spark, path)
        if table["batch"] < i:
            batch = batch.persist()
            try:
                # Segment numbers of batches are even, of compactions odd, and rise with the batch.
                segments.add_segment(state.state(batch), path, table, 2 * i, rows_per_file=settings.segment_rows)
                segments.note_versions(spark, path, table, batch)
                table["top"] = max(table["top"], batch.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0])
            finally:
                batch.unpersist()
            table["batch"] = i
            segments.publish(spark, path, table)
            table = segments.manifest(spark, path)
        if every and (i + 1) % every == 0 and table["compacted"] < i:
            segments.compact_tier(spark, path, 2 * i + 1, settings.tier_segments, settings.tier_ratio, batch=i)

    return cmds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def applied(spark: SparkSession, path: str) -> Callable[[], progress.Progress]:
    """How far a segment sink has applied its log, for the barriers of consistency.py; zeros before the first batch."""

    def now() -> progress.Progress:
        table = segments.manifest(spark, path)
        return progress.Progress(table["mark"], table["top"])

    return now
