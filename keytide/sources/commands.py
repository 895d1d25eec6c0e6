"""Change logs from tables and from JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import scalars

_PAYLOAD = "t INT, k STRING, v STRING, ttl BIGINT"


def _as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def commands(df: DataFrame, key: Column | str, version: Column | str, value: Column | str | None = None, op: Column | None = None, ttl: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): the change log of a table, and the rows that can't enter it with their reason.

    A put without a value has an empty one, a delete has none. Both frames come from one projection, so filters and
    column pruning reach the table's scan.
    """
    operation = F.lit(model.PUT) if op is None else op
    given = F.lit(None).cast("binary") if value is None else _as_column(value).cast("binary")
    rows = df.select(
        _as_column(version).cast("long").alias("version"),
        operation.alias("op"),
        _as_column(key).cast("string").alias("key"),
        F.when(operation == model.DELETE, F.lit(None).cast("binary")).otherwise(F.coalesce(given, F.lit(b""))).alias("value"),
        (F.lit(None) if ttl is None else ttl).cast("long").alias("ttl_seconds"),
    )
    reason = model.rejection(F.col("op"), F.col("key"), F.col("version"))
    return rows.where(reason.isNull()), rows.withColumn("reason", reason).where("reason is not null")


def encode(cmds: DataFrame) -> DataFrame:
    """version, payload: commands as JSON objects with t (0 put, 1 delete), k, v (base64, left out if empty) and ttl (left out if 0 or unset)."""
    v = scalars.base64(F.col("value"))
    fields = F.struct(
        F.when(F.col("op") == model.PUT, 0).otherwise(1).alias("t"),
        F.col("key").alias("k"),
        F.when(F.octet_length("value") > 0, v).alias("v"),
        F.when(F.col("ttl_seconds") != 0, F.col("ttl_seconds")).alias("ttl"),
    )
    return cmds.select("version", F.to_json(fields, {"ignoreNullFields": "true"}).alias("payload"))


def decode(log: DataFrame, payload: str = "payload", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) commands of a log of payloads; a payload that doesn't parse is rejected."""
    parsed = log.select(F.col(version).alias("_version"), F.from_json(payload, _PAYLOAD, {"mode": "PERMISSIVE"}).alias("c"))
    op = F.when(F.col("c.t") == 0, F.lit(model.PUT)).when(F.col("c.t") == 1, F.lit(model.DELETE))
    return commands(parsed, F.col("c.k"), F.col("_version"), F.unbase64("c.v"), op, F.col("c.ttl"))
