"""SimHash near-duplicates: 64-bit fingerprints of four-word shingles, linked at few differing bits, exactly.

Fingerprints that are equal are one. Two that differ in at most RADIUS bits agree in at least B - RADIUS of B blocks of
bits, so each fingerprint is filed under every choice of that many blocks, and all links are between fingerprints filed
together. B grows with the number of fingerprints (15, 35 or 70 choices), so that files stay short.

In a file, pairs are discarded by a pivot distance table: the Hamming distances of each fingerprint to PIVOTS reference
fingerprints. By the triangle inequality a pair whose distances to any pivot differ by more than RADIUS is no link: the
first pivot's distances order the file, so that such pairs aren't made, the others discard, and the survivors are
verified. A task gives out not the links but a spanning forest of them. A file with more than FILE
fingerprints isn't held in memory: its fingerprints are set aside, dealt into parts, and every two parts meet in a task
of their own, so no file is cut short.

Components come from alternating star contractions of the forest edges, each a join and an aggregate, checkpointed.

Defined cases: a null text is an empty one, whose fingerprint is zero and links like any other; a very long text is
hashed whole, SLICE shingles at a time; of rows with the smallest id and different texts the smaller hash stays; a null id is never the
smallest, and a component without ids has none; repeated rows are equal texts; an empty table gives an empty result;
further columns play no part (dedup() carries them along).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, SEED, RADIUS, PIVOTS = 4, 42, 4, 24
#: Fingerprints of one file that a task holds.
FILE = 4096
#: (fingerprints up to, blocks).
SCHEMES = ((1 << 25, 6), (1 << 31, 7), (1 << 62, 8))
#: Links that a task holds before it reduces them to a forest; a file of near copies has the square of its length.
LINKS = 1 << 19
#: Shingles hashed at a time.
SLICE = 1 << 16

_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_GAP = re.compile(rb" {2,}")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash; 0 without words."""
    joined = (text or "").encode("utf-8", "replace").lower().translate(_TO_SPACE)
    if b"  " in joined:
        joined = _GAP.sub(b" ", joined)
    joined = joined.strip(b" ")
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    n = max(1, len(starts) - WORDS + 1)
    starts, ends = starts[:n], ends[-n:]
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, SLICE):
        part = zip(starts[lo : lo + SLICE].tolist(), ends[lo : lo + SLICE].tolist(), strict=True)
        hashes = np.array([h(joined[a:b], SEED) for a, b in part], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def pivots() -> np.ndarray:
    """Reference fingerprints, by a fixed rule: the hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(PIVOTS)], dtype=np.uint64)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (row) to every pivot."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)


def links(prints: np.ndarray, keys: np.ndarray, across: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all linked pairs within equal keys, some at a time; rows are sorted by key. across: only pairs of different parts.

    Within a key rows are ordered by their distance to the first pivot, so that a row's partners end where that differs
    by more than RADIUS and pairs beyond are never made.
    """
    table = distance_table(prints)
    order = np.lexsort((table[:, 0], keys))
    first, held = table[order, 0].astype(np.int16), keys[order]
    left = np.arange(len(prints) - 1)
    step = 1
    while len(left):
        left = left[left + step < len(prints)]
        left = left[(held[left] == held[left + step]) & (first[left + step] - first[left] <= RADIUS)]
        a, b = order[left], order[left + step]
        if across is not None:
            other = across[a] != across[b]
            a, b = a[other], b[other]
        for p in range(1, PIVOTS):
            near = np.abs(table[a, p] - table[b, p]) <= RADIUS
            a, b = a[near], b[near]
            if not len(a):
                break
        ok = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
        yield a[ok], b[ok]
        step += 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, smallest node of its component) for the nodes of the links a-b that aren't the smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        new = new[new]
        if (new == root).all():
            break
        root = new
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def reduced(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of all links found, of which at most about LINKS are held at once."""
    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for pair in found:
        held.append(pair)
        n += len(pair[0])
        if n > LINKS:
            held, n = [forest(*map(np.concatenate, zip(*held, strict=True)))], 0
    return forest(*map(np.concatenate, zip(*held, strict=True)))


def prints_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the fingerprint as a signed number) of every row."""

    def make():
        def f(x: dict) -> dict:
            signed = np.array([fingerprint(t) for t in x["text"]], dtype=np.uint64).view(np.int64)
            return {"doc_id": x["id"], "h": x["h"], "fp": signed}

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return common.map_rows(rows, make, "doc_id long, h long, fp long")


def masks(blocks: int) -> list[int]:
    """Signed masks of every choice of blocks - RADIUS blocks."""
    at = [64 * i // blocks for i in range(blocks + 1)]
    whole = [(1 << at[i + 1]) - (1 << at[i]) for i in range(blocks)]
    out = [sum(whole[i] for i in keep) for keep in combinations(range(blocks), blocks - RADIUS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _forests(files: DataFrame, whole: bool) -> DataFrame:
    """a, b, key: forest edges (null key) of rows (key, part, fp) sorted by key; of files too long for a task, if not whole, the rows themselves (null b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        aside = None  # the key whose rows are being set aside

        def give(a, b, key) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

        def edges(key, part, fp) -> pa.RecordBatch:
            prints = fp.view(np.uint64)
            a, b = reduced(links(prints, key, part if whole else None))
            x, y = forest(fp[a], fp[b])
            return give(x, y, [None] * len(x))

        for batch in common.joined(batches, 1 << 15):
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            if aside is not None:
                same = int(np.searchsorted(new[0] != aside, True)) if (new[0] != aside).any() else len(new[0])
                if same:
                    yield give(new[2][:same], [None] * same, new[0][:same])
                if same == len(new[0]):
                    continue
                aside, new = None, [x[same:] for x in new]
            rows = [np.concatenate(p) for p in zip(kept, new, strict=True)]
            if not len(rows[0]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            last = int(starts[-1])
            sizes = np.diff(np.concatenate([starts, [len(rows[0])]]))
            if not whole and sizes.max() > FILE:
                long = np.repeat(sizes > FILE, sizes)
                yield give(rows[2][long], [None] * int(long.sum()), rows[0][long])
                if sizes[-1] > FILE:
                    aside = int(rows[0][-1])
                short = [x[~long] for x in rows]
                cut = len(short[0]) if aside is not None else len(short[0]) - int(sizes[-1])
                rows, last = short, cut
            if last:
                yield edges(*(x[:last] for x in rows))
            kept = [x[last:] for x in rows]
        if len(kept[0]):
            yield edges(*kept)

    return files.select("key", "part", "fp").mapInArrow(run, "a long, b long, key long")


def edges(nodes: DataFrame) -> DataFrame:
    """Forest edges (a, b) between the distinct fingerprints in nodes (fp), such that linked fingerprints are connected."""
    spark = nodes.sparkSession
    n = nodes.count()
    blocks = next(b for most, b in SCHEMES if n <= most)
    filed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(masks(blocks))])).alias("k"))
    filed = filed.select(F.xxhash64("k.i", "k.m").alias("key"), F.lit(0).alias("part"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = common.materialize(_forests(filed.repartition(parts, "key").sortWithinPartitions("key"), whole=False))
    found = first.where("b is not null").select("a", "b")
    aside = first.where("b is null").select("key", F.col("a").alias("fp"))
    sizes = aside.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if sizes.isEmpty():
        return found.distinct()
    # Every two parts of a long file meet; links inside a part are found where the part meets itself.
    count = F.ceil(F.col("n") / (FILE // 2)).cast("long")
    dealt = aside.join(sizes, "key").withColumn("parts", count).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")))
    meet = dealt.select("key", "fp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    inside = meet.where("part = other").select(F.xxhash64("key", "part", "part").alias("key"), F.col("fp").alias("part"), "fp")
    across = meet.where("part <> other").select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "part", "fp")
    tiles = inside.unionByName(across).repartition(parts, "key").sortWithinPartitions("key")
    return found.unionByName(_forests(tiles, whole=True).select("a", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """fp, root of every node of the edges (a, b): the smallest node of its component, by alternating stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Every node's neighbours (the larger ones, or the others and itself) get the edge to its smallest neighbour."""
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        # Written down, the smallest neighbours are a join's plain side, so that Spark can split a hub's edges.
        least = common.materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        r = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], r[1]

    now = common.materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    while before[0]:
        # After a large star every edge again goes from the larger node to the smaller.
        now = common.materialize(star(star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def groups(prints: DataFrame) -> DataFrame:
    """fp, first (the smallest struct (no id, id, h) of its component) of every distinct fingerprint of prints (doc_id, h, fp)."""
    key = F.struct(F.col("doc_id").isNull().alias("anonymous"), F.col("doc_id"), F.col("h"))
    nodes = common.materialize(prints.groupBy("fp").agg(F.min(key).alias("first")))
    roots = common.materialize(components(edges(nodes.select("fp"))))
    firsts = nodes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("best"))
    found = roots.join(firsts, "root").select("fp", "best")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("best", "first").alias("first"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = common.materialize(prints_of(docs, id_col, text_col))
    # Written down, the groups are a join's plain side, so that Spark can split a hot fingerprint's rows.
    return prints.join(common.materialize(groups(prints)), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component: that with the smallest id (and then hash of its text)."""
    prints = common.materialize(prints_of(docs, id_col, text_col))
    kept = common.materialize(groups(prints).select(F.col("first.doc_id").alias("keep_id"), F.col("first.h").alias("keep_h")).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({"id": F.col(f"row.`{id_col}`").cast("long"), "h": F.xxhash64(F.col(f"row.`{text_col}`"))})
    out = packed.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")), "left_semi")
    # Rows that repeat both id and text are rare; only if there are any, one of each is picked.
    if not prints.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["id", "h"])
    return out.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
