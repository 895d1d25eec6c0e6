"""Bloom filters over keys: sizing, distributed building, probing.

For skipping files on point reads, segments carry Parquet's own filters. This one is for asking which keys of a frame
may be in a set. Its bits are gathered as 64-bit words by an aggregate, so building never holds a set in one place; they
are broadcast for probing only up to MAX_BROADCAST_BITS, and joined beyond.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import scalars

#: 16 MB of bits.
MAX_BROADCAST_BITS = 1 << 27


def size(n: int, p: float) -> tuple[int, int]:
    """Bits m and hashes k for n keys at a false-positive rate p."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("a filter needs n >= 1 and 0 < p < 1")
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))


@dataclasses.dataclass(frozen=True)
class BloomFilter:
    """words: a frame (word long, bits long) of the 64-bit words that have bits set."""

    m: int
    k: int
    words: DataFrame


def positions(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """The rows of keys with their bit numbers in "positions"."""

    @F.pandas_udf("array<long>")
    def at(x):
        import pandas as pd

        return pd.Series(list(scalars.position_rows(scalars._bytes(x), m, k)))

    return keys.withColumn("positions", at(F.col(key)))


def build(keys: DataFrame, key: str = "key", n: int | None = None, p: float = config.Config.bloom_fpp) -> BloomFilter:
    n = keys.count() if n is None else n
    m, k = size(max(1, n), p)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(scalars.position_rows(scalars._bytes(batch.column(0).to_pylist()), m, k))
            word, bit = at // 64, np.left_shift(np.uint64(1), (at % 64).astype(np.uint64))
            found, first = np.unique(word, return_index=True)
            bits = np.bitwise_or.reduceat(bit, first).view(np.int64) if len(found) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(bits, pa.int64())], names=["word", "bits"])

    parts = keys.where(F.col(key).isNotNull()).select(F.col(key)).mapInArrow(words, "word long, bits long")
    return BloomFilter(m, k, parts.groupBy("word").agg(F.bit_or("bits").alias("bits")))


def probe(keys: DataFrame, found: BloomFilter, key: str = "key") -> DataFrame:
    """The rows of keys with may_contain: false only for keys that are not in the set."""
    if found.m > MAX_BROADCAST_BITS:
        return _probe_by_join(keys, found, key)
    table = np.zeros((found.m + 63) // 64, dtype=np.uint64)
    rows = found.words.toArrow()
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    shared, m, k = keys.sparkSession.sparkContext.broadcast(table), found.m, found.k

    @F.pandas_udf("boolean")
    def contains(x):
        import pandas as pd

        at = scalars.position_rows(scalars._bytes(x), m, k)
        bits = shared.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
        return pd.Series(bits.all(axis=1))

    return keys.withColumn("may_contain", contains(F.col(key)))


def _probe_by_join(keys: DataFrame, found: BloomFilter, key: str) -> DataFrame:
    """Each distinct key's bits meet the words in a join; a key may be contained if all of its bits are set."""
    asked = positions(keys.select(F.col(key).alias("_key")).distinct(), "_key", found.m, found.k).select("_key", F.explode("positions").alias("at"))
    met = asked.withColumn("word", F.floor(F.col("at") / 64)).join(found.words, "word", "left")
    is_set = F.coalesce(F.expr("shiftrightunsigned(bits, cast(at % 64 as int)) & 1"), F.lit(0)) == 1
    told = met.groupBy("_key").agg(F.bool_and(is_set).alias("may_contain"))
    return keys.join(told, keys[key].eqNullSafe(told["_key"]), "left").drop("_key")
