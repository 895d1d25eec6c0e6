"""Scalar functions: checksums, hashes, base64, number parsing, bucket bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The offset basis and prime of 64-bit FNV-1a, and the multiplier of the finalizer.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MIX_MULTIPLIER = 0xFF51AFD7ED558CCD


def crc32(data: Column) -> Column:
    """CRC-32 (IEEE) of bytes, as a long."""
    return F.crc32(data)


def base64(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def parse_long(text: Column) -> Column:
    """A decimal number with an optional sign and nothing else, or 0."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), F.coalesce(text.try_cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def exponential_bounds(start: float, factor: float, count: int) -> Column:
    """An array of count bounds, each factor times the one before."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(start) * F.pow(F.lit(factor), i))


def fnv1a_rows(data: list[bytes | None]) -> np.ndarray:
    """FNV-1a of every item, all items a byte at a time; None counts as empty."""
    sizes = np.array([len(x or b"") for x in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(x or b"" for x in data), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    out = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    order = np.argsort(-sizes, kind="stable")
    live = len(data)
    with np.errstate(over="ignore"):
        for at in range(int(sizes.max(initial=0))):
            while live and sizes[order[live - 1]] <= at:
                live -= 1
            rows = order[:live]
            out[rows] = (out[rows] ^ flat[starts[rows] + at]) * np.uint64(FNV_PRIME)
    return out


def mix_rows(x: np.ndarray) -> np.ndarray:
    """The finalizer: xor with the upper half shifted down, multiply, and again."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_MULTIPLIER)
    return x ^ (x >> np.uint64(33))


def position_rows(data: list[bytes | None], m: int, k: int) -> np.ndarray:
    """Bit numbers of every item (row) in a filter of m bits, by double hashing."""
    a = fnv1a_rows(data)
    b = mix_rows(a)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(m) for i in range(k)], axis=1).astype(np.int64)


def _bytes(x) -> list[bytes | None]:
    return [None if v is None else v.encode("utf-8") if isinstance(v, str) else bytes(v) for v in x]


def fnv1a64(data: Column) -> Column:
    """FNV-1a of strings (UTF-8) or bytes, as a signed long; null for null."""

    @F.pandas_udf("long")
    def hashed(x: pd.Series) -> pd.Series:
        items = _bytes(x)
        return pd.Series(fnv1a_rows(items).view(np.int64), dtype="Int64").mask([v is None for v in items])

    return hashed(data)


def mix64(x: Column) -> Column:
    """The finalizer of a signed long; null for null."""

    @F.pandas_udf("long")
    def mixed(v: pd.Series) -> pd.Series:
        known = v.notna()
        return pd.Series(mix_rows(v.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64), dtype="Int64").where(known)

    return mixed(x)
