"""Schemas and validation of the versioned key-value model.

A change log is a DataFrame of commands. Its version column is a total order with at most one command a version; gaps are
legal. State at a version is, for each key, the command with the greatest version up to it; a delete stays as a
tombstone row. Keys compare as unsigned bytes, which is the default string order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = "put", "delete"

COMMANDS = T.StructType([T.StructField("version", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.BinaryType()), T.StructField("ttl_seconds", T.LongType())])
STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()), T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType())])
LIVE = T.StructType(STATE.fields[:3])
GET = T.StructType([T.StructField("key", T.StringType()), T.StructField("found", T.BooleanType()), T.StructField("value", T.BinaryType()), T.StructField("version", T.LongType())])
WATCH_EVENT = T.StructType([T.StructField("type", T.StringType()), *LIVE.fields])
STATUS = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("leader", T.StringType()), T.StructField("state", T.StringType()), T.StructField("commit_index", T.LongType()), T.StructField("applied_index", T.LongType()), T.StructField("peers", T.ArrayType(T.StringType()))])

MODES = ("strong", "eventual", "read-your-writes", "monotonic")


def rejection(op: Column, key: Column, version: Column) -> Column:
    """Why a command can't enter the log, or null."""
    return (
        F.when(key.isNull() | (key == ""), F.lit("empty key"))
        .when(version.isNull() | (version < 0), F.lit("no version"))
        .when(op.isNull() | ~op.isin(PUT, DELETE), F.lit("unknown operation"))
    )


def resolve_mode(requested: str | None = None, header: str | None = None, lenient: bool = False) -> str:
    """Consistency mode of a read: the request's, else the header's, else eventual. lenient: unknown ones are eventual."""
    mode = requested or header or "eventual"
    if mode in MODES:
        return mode
    if lenient:
        return "eventual"
    raise ValueError(f"unknown consistency mode {mode!r}")
