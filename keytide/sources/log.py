"""A stored change log: validated commands are appended with rising versions, and read back keyed and sorted.

An append numbers its valid commands on from the last committed version, writes them to a folder of a new name, moves it
into the log, and commits by a numbered record (storage.py) that names the folder and its versions. Readers and streams
read committed folders; one that was moved but never committed is replaced by the next append, which has its number. There
is one writer at a time: of two, one fails at the record. A stream takes folders as they appear, so it is to be started
behind a barrier or over a log whose writer has not died between the two steps.
"""

from __future__ import annotations

import dataclasses
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, model
from . import commands, storage


@dataclasses.dataclass(frozen=True)
class Appended:
    """Versions of an append (last is before first if it had no valid command), and the commands that were rejected with their reasons."""

    first: int
    last: int
    rejected: DataFrame


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Numbers rows from 0 in an order, which should be total. Ranges are sorted apart; only their counts come together."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # Written down, as the ranges come from a sample that another run might draw otherwise.
    path = storage.shared_folder(spark, "numbered")
    ranged.write.mode("overwrite").parquet(path)
    storage.remove_at_exit(spark, path)
    kept = spark.read.parquet(path)
    counts = sorted((r.part, r["count"]) for r in kept.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    starts = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    before = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(before, F.shiftright("_at", 33) == F.col("_part")).withColumn(name, number).drop("_at", "_part", "_before")


class Log:
    """A log below a path; partitions: files of an append, Spark's choice if unset."""

    def __init__(self, spark: SparkSession, path: str = config.Config.data_dir, partitions: int | None = None):
        self.spark, self.path, self.partitions = spark, storage.qualified(spark, path), partitions

    def _commits(self) -> str:
        return f"{self.path}/_commits"

    def last_version(self) -> int:
        found = storage.last_record(self.spark, self._commits())
        return found[1]["last"] if found else 0

    def append(self, rows: DataFrame, key: Column | str, value: Column | str | None = None, op: Column | None = None, ttl: Column | None = None, order: Column | str = "order") -> Appended:
        """Append the commands of rows in an order of their own; empty keys and unknown operations are rejected and get no version."""
        operation, name = F.lit(model.PUT) if op is None else op, F.col(key) if isinstance(key, str) else key
        placed = rows.withColumn("_order", F.col(order) if isinstance(order, str) else order)
        _, rejected = commands.commands(placed, name, F.lit(0), value, operation, ttl)
        valid = placed.where(model.rejection(operation, name, F.lit(0)).isNull())
        given, _ = commands.commands(numbered(valid, "_order", name="_number"), name, F.col("_number") + self.last_version() + 1, value, operation, ttl)
        return self._commit(given, rejected.drop("version"))

    def append_versioned(self, cmds: DataFrame) -> Appended:
        """Append commands that have versions already, all greater than the last one."""
        reason = model.rejection(F.col("op"), F.col("key"), F.col("version"))
        reason = F.coalesce(reason, F.when(F.col("version") <= self.last_version(), F.lit("old version")))
        marked = cmds.withColumn("reason", reason)
        return self._commit(marked.where("reason is null").drop("reason"), marked.where("reason is not null"))

    def _commit(self, valid: DataFrame, rejected: DataFrame) -> Appended:
        number, last = self._next()
        staged, name = f"{self.path}/_staged-{uuid.uuid4().hex}", f"append={number:012d}"
        rows = valid.select("version", "op", "key", "value", "ttl_seconds")
        dealt = rows.repartitionByRange(self.partitions, "key") if self.partitions else rows.repartitionByRange("key")
        dealt.sortWithinPartitions("key", "version").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(staged)
        written = self.spark.read.schema(model.COMMANDS).parquet(staged)
        n, low, high = written.agg(F.count(F.lit(1)), F.min("version"), F.max("version")).first()
        if not n:
            storage.remove(self.spark, staged)
            return Appended(last + 1, last, rejected)
        storage.remove(self.spark, f"{self.path}/{name}")  # moved there by an append that never committed
        storage.move(self.spark, staged, f"{self.path}/{name}")
        storage.put_record(self.spark, self._commits(), number, {"folder": name, "first": low, "last": high, "rows": n})
        return Appended(low, high, rejected)

    def _next(self) -> tuple[int, int]:
        found = storage.last_record(self.spark, self._commits())
        return (found[0] + 1, found[1]["last"]) if found else (0, 0)

    def read(self) -> DataFrame:
        """The committed commands. Filters on the key reach the files' statistics and bloom filters."""
        folders = []
        for i in storage.record_numbers(self.spark, self._commits()):
            folders.append(f"{self.path}/{storage.last_record(self.spark, self._commits(), i)[1]['folder']}")
        if not folders:
            return self.spark.createDataFrame([], model.COMMANDS)
        return self.spark.read.schema(model.COMMANDS).parquet(*folders)

    def stream(self, files_per_batch: int | None = None) -> DataFrame:
        """A stream of the commands, as appends bring them."""
        reader = self.spark.readStream.schema(model.COMMANDS).option("pathGlobFilter", "*.parquet")
        reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
        return reader.parquet(f"{self.path}/append=*")


class Batcher:
    """Gathers single commands and appends them together: at flush_commands of them, or when the first has waited flush_ms at the next submit, or at flush()."""

    def __init__(self, log: Log, settings: config.Config = config.Config(), clock=time.monotonic):
        self._log, self._settings, self._clock = log, settings, clock
        self._held: list[tuple] = []
        self._since = 0.0

    def put(self, key: str, value: bytes, ttl_seconds: int | None = None) -> Appended | None:
        return self.submit(model.PUT, key, value, ttl_seconds)

    def delete(self, key: str) -> Appended | None:
        return self.submit(model.DELETE, key, None, None)

    def submit(self, op: str, key: str, value: bytes | None, ttl_seconds: int | None = None) -> Appended | None:
        """The append that this command completed, or None if it waits for others. An empty key or unknown operation is an error at once."""
        if not key or op not in (model.PUT, model.DELETE):
            raise ValueError("empty key" if not key else f"unknown operation {op!r}")
        now = self._clock()
        if not self._held:
            self._since = now
        self._held.append((len(self._held), op, key, value, ttl_seconds))
        if len(self._held) >= self._settings.flush_commands or (now - self._since) * 1000 >= self._settings.flush_ms:
            return self.flush()
        return None

    def flush(self) -> Appended | None:
        """Append what is held, if anything is, in the order of submission."""
        if not self._held:
            return None
        rows = self._log.spark.createDataFrame(self._held, "number long, op string, key string, value binary, ttl_seconds long")
        out = self._log.append(rows, "key", "value", F.col("op"), F.col("ttl_seconds"), "number")
        self._held = []
        return out
