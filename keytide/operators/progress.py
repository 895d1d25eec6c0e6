"""Which versions of a log have been applied, when files may bring them in any order.

Versions are noted as blocks of BITS versions, a bit each, so that repeated deliveries change nothing. The mark is the
greatest version up to which every one from 1 on has been applied or declared a gap: below it nothing can still come. The
top is the greatest applied version. A gap that isn't declared holds the mark back, which is slow but never wrong.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
SCHEMA = "block bigint, bits bigint"


@dataclasses.dataclass(frozen=True)
class Progress:
    mark: int = 0
    top: int = 0


def blocks(versions: DataFrame, column: str = "version") -> DataFrame:
    """block, bits of a frame's versions."""
    v = F.col(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(BITS)).cast("int"))
    return versions.where(v.isNotNull()).select(F.floor(v / BITS).cast("long").alias("block"), bit.alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("bits"))


def united(noted: DataFrame, mark: int = 0) -> DataFrame:
    """The blocks from the mark's on, each once."""
    return noted.where(F.col("block") >= mark // BITS).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def mark_of(noted: DataFrame, mark: int = 0) -> int:
    """The mark that the blocks allow, given an earlier one. Found by a join of full blocks with their successors, so without a sort."""
    first = mark // BITS
    # What the earlier mark covers of its own block is given; version 0 always is.
    given = (1 << (mark % BITS + 1)) - 1
    known = united(noted, mark).withColumn("bits", F.when(F.col("block") == first, F.col("bits").bitwiseOR(F.lit(_signed(given)))).otherwise(F.col("bits")))
    full = known.where(F.col("bits") == -1).select("block")
    after = full.select((F.col("block") + 1).alias("block")).join(full, "block", "left_anti")
    open_ = after.agg(F.min("block")).first()[0] if _has(full, first) else first
    row = known.where(F.col("block") == open_).first()
    bits = (row.bits if row else _signed(given) if open_ == first else 0) & (1 << BITS) - 1
    ones = 0
    while bits >> ones & 1:
        ones += 1
    return open_ * BITS + ones - 1


def _has(full: DataFrame, block: int) -> bool:
    return not full.where(F.col("block") == block).isEmpty()


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >= 1 << (BITS - 1) else bits


def of_log(cmds: DataFrame, gaps: DataFrame | None = None) -> Progress:
    """How far a log at rest goes, with the versions (column version) that are declared gaps."""
    noted = blocks(cmds)
    if gaps is not None:
        noted = noted.unionByName(blocks(gaps))
    top = cmds.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    return Progress(mark_of(noted), top)
