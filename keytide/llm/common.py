"""Shared helpers: shared-folder checkpoints, Arrow row mapping, stable folds."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

#: ASCII white space, the word separator of every contract here.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of an Arrow batch: operators that hand texts to Python set this one value for the session where it still has Spark's own, which would keep ten times as many texts in an executor's memory, and otherwise cut larger batches.
BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS for the session, unless it has a bound of its own."""
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or, on a local master alone, a new one (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            where = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="keytide-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return where


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, with the scheme of its file system."""
    return storage.qualified(spark, posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterable[dict] | dict]], schema: str) -> DataFrame:
    """Arrow batches through a function of a batch's columns.

    ``make()`` runs once in each task and returns ``f(columns) -> columns`` where columns is a dict of lists, of at most
    BATCH_ROWS rows at a time.
    """
    bound_batches(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in cut(batches):
            columns = f({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def cut(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, without empty ones."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def joined(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to so many rows at least, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow's form of a flat DDL schema of the kinds used here."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.strip().split(" ", 1) for x in schema.split(","))])


def id_fold(key: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo folds; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)
