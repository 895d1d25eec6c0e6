"""Small files and folders through Hadoop's file systems: the same on a local disk, HDFS or an object store.

A numbered record is a small JSON file that is created whole and never overwritten; the greatest number is the current
one. So a writer that dies leaves either the old record or the new one, and two writers can't both write a number.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, Spark's default where it has none."""
    fs, p = _path(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _path(spark, source)
    if not fs.rename(p, _path(spark, target)[1]):
        raise OSError(f"can't move {source} to {target}")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data when the driver ends."""
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, by a new name, below spark.checkpoint.dir, which driver and executors share; on a local master where that is unset, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{os.urandom(8).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return tempfile.mkdtemp(prefix=f"keytide-{name}-")


def put_record(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Create the numbered record; raises if it is there already."""
    fs, p = _path(spark, f"{folder}/{number:012d}.json")
    temporary = f"{folder}/.{number:012d}.{os.urandom(4).hex()}"
    _, t = _path(spark, temporary)
    out = fs.create(t, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(t, p):
        fs.delete(t, False)
        raise FileExistsError(str(p))


def last_record(spark: SparkSession, folder: str, number: int | None = None) -> tuple[int, dict] | None:
    """The greatest numbered record, or that of a number."""
    known = [x for x in names(spark, folder) if x.endswith(".json") and not x.startswith(".")]
    if number is not None:
        known = [x for x in known if int(x.split(".")[0]) == number]
    if not known:
        return None
    fs, p = _path(spark, f"{folder}/{known[-1]}")
    stream = fs.open(p)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return int(known[-1].split(".")[0]), json.loads(text)


def record_numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(x.split(".")[0]) for x in names(spark, folder) if x.endswith(".json") and not x.startswith(".")]
