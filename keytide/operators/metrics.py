"""Operational metrics as aggregates: histograms, counters, exact percentiles, sizes, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars
from . import state

#: Bytes that an entry of the in-memory table has besides key and value.
ENTRY_OVERHEAD = 24


def latency_histogram(requests: DataFrame, value: str, labels: list[str], start: float, factor: float = 2.0, count: int = 14) -> DataFrame:
    """Cumulative counts up to each bound (le, +Infinity last), with each label's total sum and count.

    A row is counted once, in the first bucket that holds it; running sums over the few buckets make them cumulative.
    """
    bounds = scalars.exponential_bounds(start, factor, count)
    bucket = F.size(F.filter(bounds, lambda b: b < F.col(value)))
    counts = requests.where(F.col(value).isNotNull()).groupBy(*labels, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).alias("s"))
    series = counts.groupBy(*labels).agg(F.sum("n").alias("count"), F.sum("s").alias("sum")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(count))))
    le = F.coalesce(F.try_element_at(bounds, F.col("bucket") + 1), F.lit(float("inf")))
    by = W.partitionBy(*labels).orderBy("bucket")
    return series.join(counts.drop("s"), [*labels, "bucket"], "left").select(*labels, le.alias("le"), F.sum(F.coalesce("n", F.lit(0))).over(by).alias("cumulative"), F.col("sum").cast("double").alias("sum"), "count")


def op_counts(requests: DataFrame, op: str = "op", status: str | None = None) -> DataFrame:
    return requests.groupBy(op, *([status] if status else [])).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """p, value, n: the item at place min(floor(n * p), n - 1) of the sorted values, exactly.

    Values are counted by their distinct values; the distinct values are cut into ranges whose counts say which one holds
    each place, and only those ranges are sorted. No task gets all values, even if most are equal.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    limits = sorted(set(df.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col("v"))) if limits else F.lit(0)
    ranged = values.withColumn("part", part)
    # At most 64 rows.
    parts = ranged.groupBy("part").agg(F.sum("c").alias("c"))
    order = W.orderBy("part")
    spans = parts.select("part", (F.sum("c").over(order) - F.col("c")).alias("before"), F.col("c").alias("inside"), F.sum("c").over(W.partitionBy()).alias("n"))
    asked = spans.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("place", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1))
    hit = asked.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("inside")))
    wanted = hit.select("part").distinct()
    upto = W.partitionBy("part").orderBy("v")
    sorted_values = ranged.join(F.broadcast(wanted), "part").select("part", "v", "c", F.sum("c").over(upto).alias("upto"))
    met = sorted_values.join(F.broadcast(hit), "part").where((F.col("place") - F.col("before") < F.col("upto")) & (F.col("place") - F.col("before") >= F.col("upto") - F.col("c")))
    return met.select("p", F.col("v").alias("value"), "n")


def memtable_size(cmds: DataFrame) -> DataFrame:
    """keys, bytes: what an in-memory table counts, each key and its first value with a fixed overhead."""
    first = cmds.groupBy("key").agg(F.min_by(F.coalesce(F.octet_length("value"), F.lit(0)), "version").alias("value_bytes"))
    return first.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.octet_length("key") + F.col("value_bytes") + ENTRY_OVERHEAD), F.lit(0)).cast("long").alias("bytes"))


def throughput(requests: DataFrame, at: str, labels: list[str]) -> DataFrame:
    """labels, n, seconds, per_second: requests over the time from the first to the last; null where that is no time."""
    seconds = (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))) / F.lit(1e6)
    sums = requests.where(F.col(at).isNotNull()).groupBy(*labels).agg(F.count(F.lit(1)).alias("n"), seconds.alias("seconds"))
    return sums.withColumn("per_second", F.try_divide(F.col("n"), F.col("seconds")))


def statuses(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """op and status of requests, for op_counts: ok for the commands of a log, the reason for the rejected ones."""
    return valid.select("op", F.lit("ok").alias("status")).unionByName(rejected.select("op", F.col("reason").alias("status")))


def status(cmds: DataFrame, applied: DataFrame | None = None, node_id: str = config.Config.node_id, peers: tuple[str, ...] = (), term: int = 0) -> DataFrame:
    """One row: the log's greatest version, the applied one, readiness, counts of keys and the running watches. A single driver leads itself; its term is the number of its log's last append."""
    latest = state.state(cmds).agg(F.coalesce(F.max("version"), F.lit(0)).alias("commit_index"), F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("deleted")).alias("live_keys"))
    # The latest row of some key has the greatest version, so one pass gives all; another log's is a frame of one row.
    rows = latest.withColumn("applied_index", F.col("commit_index")) if applied is None else latest.join(F.broadcast(applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("applied_index"))), F.lit(True))
    watchers = len(cmds.sparkSession.streams.active)
    return rows.select(
        F.lit(node_id).alias("node_id"), F.lit(node_id).alias("leader"), F.lit("Leader").alias("state"), F.lit(term).cast("long").alias("term"), "commit_index", "applied_index", (F.col("applied_index") > 0).alias("ready"),
        "keys", "live_keys", F.lit(watchers).cast("long").alias("active_watchers"), F.array(*map(F.lit, peers)).cast("array<string>").alias("peers"),
    )
