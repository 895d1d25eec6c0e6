"""Point reads, multi-key reads and scans over the live view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import state


def multi_get(cmds: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """key, found, value, version of every asked key; a deleted key isn't found but shows its tombstone's version.

    Only the asked keys' commands are reduced: a semi join, broadcast by Spark when the keys are few, comes first.
    """
    asked = keys.select(F.col(key).alias("key")).distinct()
    known = state.state(cmds.join(asked, "key", "left_semi"))
    return asked.join(known, "key", "left").select("key", F.coalesce(~F.col("deleted"), F.lit(False)).alias("found"), F.when(~F.col("deleted"), F.col("value")).alias("value"), "version")


def get(cmds: DataFrame, key: str) -> DataFrame:
    """One row for the key, found or not. The key's filter reaches the scan of the log."""
    spark = cmds.sparkSession
    return multi_get(cmds.where(F.col("key") == key), spark.range(1).select(F.lit(key).alias("key")))


def exists(cmds: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The asked keys that are live."""
    asked = keys.select(F.col(key).alias("key")).distinct()
    return state.live(cmds.join(asked, "key", "left_semi")).select("key")


def _limited(rows: DataFrame, limit: int) -> DataFrame:
    """In key order; a limit of 0 or less is none. Limits count live rows of the merged result."""
    return rows.orderBy("key").limit(limit) if limit > 0 else rows.orderBy("key")


def scan_from(cmds: DataFrame, start: str = "", limit: int = 0) -> DataFrame:
    """Live rows with keys from start on."""
    return scan_range(cmds, start, "", limit)


def scan_range(cmds: DataFrame, start: str = "", end: str = "", limit: int = 0) -> DataFrame:
    """Live rows with start <= key < end; an empty end is none."""
    if start:
        cmds = cmds.where(F.col("key") >= start)
    if end:
        cmds = cmds.where(F.col("key") < end)
    return _limited(state.live(cmds), limit)


def scan_prefix(cmds: DataFrame, prefix: str = "", limit: int = 0) -> DataFrame:
    """Live rows with keys that start with the prefix; an empty one is all."""
    return _limited(state.live(cmds.where(F.col("key").startswith(prefix)) if prefix else cmds), limit)


def scan_entries(cmds: DataFrame, start: str = "", end: str = "", limit: int = 0) -> DataFrame:
    """State rows with start <= key < end in key order, tombstones included; limits count them too."""
    if start:
        cmds = cmds.where(F.col("key") >= start)
    if end:
        cmds = cmds.where(F.col("key") < end)
    return _limited(state.state(cmds), limit)


def as_json(rows: DataFrame) -> DataFrame:
    """Live rows as JSON objects of key, value (base64) and version, in the order of the rows."""
    return rows.select("key", F.to_json(F.struct("key", scalars.base64(F.col("value")).alias("value"), "version")).alias("json"))
