"""The state of a change log: latest by key, live rows, tombstones, past versions, merged layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model


def latest(df: DataFrame, key: str = "key", order: str | list[Column] = "version", strategy: str = "window") -> DataFrame:
    """One row a key: that of the greatest version, tombstones included.

    "window" keeps the first row of each key by rank. Spark prunes to one row a key before the shuffle, so superseded
    values never travel and a hot key is reduced where it is read. "aggregate" is max_by over a row struct, which also
    works on streams. Filters on the key pass through both to the scan. "rejoin" finds the greatest version by a hash
    aggregate over two columns and joins the rows back, which pays where values are large and most keys have one version.
    """
    if strategy == "window":
        by = [F.col(order).desc()] if isinstance(order, str) else order
        return df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*by))).where("_rank = 1").drop("_rank")
    if strategy == "aggregate":
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*").select(*df.columns)
    if strategy == "rejoin":
        top = df.groupBy(key).agg(F.max(order).alias(order))
        return df.join(top, [key, order], "left_semi")
    raise ValueError(f"unknown strategy {strategy!r}")


def state(cmds: DataFrame, strategy: str = "window") -> DataFrame:
    """key, value, version, deleted of every key ever written."""
    rows = cmds.select("key", "value", "version", (F.col("op") == model.DELETE).alias("deleted"))
    return latest(rows, strategy=strategy).select("key", F.when(~F.col("deleted"), F.col("value")).alias("value"), "version", "deleted")


def live(cmds: DataFrame, strategy: str = "window") -> DataFrame:
    """key, value, version of the keys that aren't deleted. The filter stays above the reduction."""
    return state(cmds, strategy).where(~F.col("deleted")).select("key", "value", "version")


def tombstones(cmds: DataFrame) -> DataFrame:
    return state(cmds).where("deleted").select("key", "version")


def as_of(cmds: DataFrame, version: int) -> DataFrame:
    """The commands up to a version; state() and the reads over it see the past."""
    return cmds.where(F.col("version") <= version)


def history(cmds: DataFrame) -> DataFrame:
    """Every version of every key, with its number, the version before it, and the version that ended it."""
    by = W.partitionBy("key").orderBy("version")
    return cmds.select(
        "key",
        "version",
        "op",
        "value",
        F.row_number().over(by).cast("long").alias("revision"),
        F.lag("version").over(by).alias("previous_version"),
        F.lead("version").over(by).alias("next_version"),
    )


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """One row a key over layers of state rows, newest layer first: the greatest version wins, and at equal versions the newer layer."""
    ranked = [x.select("key", "value", "version", "deleted", F.lit(i).alias("_layer")) for i, x in enumerate(layers)]
    return latest(reduce(DataFrame.unionByName, ranked), order=[F.col("version").desc(), F.col("_layer").asc()]).drop("_layer")


def snapshot_plus_tail(snapshot: DataFrame, snapshot_version: int, cmds: DataFrame) -> DataFrame:
    """The live rows after a snapshot of live rows has been followed by the commands beyond its version.

    The snapshot replaces whatever was there: keys that it lacks exist only if a later command wrote them.
    """
    tail = cmds.where(F.col("version") > snapshot_version).select("key", "value", "version", (F.col("op") == model.DELETE).alias("deleted"))
    base = snapshot.select("key", "value", "version", F.lit(False).alias("deleted"))
    return latest(base.unionByName(tail)).where(~F.col("deleted")).select("key", "value", "version")
