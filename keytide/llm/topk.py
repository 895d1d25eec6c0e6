"""Exact top-k inner products over norm buckets.

Components are scaled and floored to integers. Candidates are grouped by vector length into buckets, at every table size,
and buckets are split into blocks of bounded size, each one matrix. A first pass over the longest vectors gives each
query a score that its k-th best result reaches at least; over the query's length it is the least length that a
candidate must have. Queries are sorted by it and cut into chunks, so that a chunk's queries ask for like lengths, and a
chunk visits the blocks only of buckets that are long enough.

In a block, a query's local cosine threshold is its score over the product of its length and the block's longest. A bucket
prunes by length where that is low: the candidates of sufficient length are a prefix of the block. It prunes by
coordinates where it is high: the product over the query's FOCUS strongest coordinates, with the Cauchy-Schwarz bound for
the others, must reach the score. Where high begins is measured in each block, on some queries of each chunk whose
thresholds lie where nothing is known yet, as the lowest one from which coordinates leave less than WORTH of the
candidates. Survivors are verified by exact products.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a row without an
id; an empty vector scores 0; shorter vectors count as padded with zeros; of rows that repeat a query's id the smallest
vector is the query, and none of them is among its results; repeated candidates are results each for itself; ties go to
the smaller id; scores beyond 64 bits saturate, and components beyond the range of doubles after scaling count as the
largest double; with fewer candidates than k all are returned; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SCALE = 1024
#: Components of the vectors in a block, in a chunk of queries, and of the longest vectors that give the first scores: 4096, 256 and 2048 vectors of 64.
BLOCK, CHUNK, SEEDS = 1 << 18, 1 << 14, 1 << 17
#: Buckets by length; blocks of a bucket grow in number instead. Tasks for each of the session's shuffle partitions at most.
BUCKETS, TASKS = 64, 4
#: Coordinates by which candidates are pruned, the share of candidates that pays, and queries on which it is measured.
FOCUS, WORTH, PROBES = 16, 0.25, 8
#: Products below this are exact in doubles.
EXACT = float(2**53)


def _pad(vectors: list[list[float]], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, vectors)])
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    grow = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return (a if a.shape[1] == width else grow(a)), (b if b.shape[1] == width else grow(b))


def _length(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", m, m))


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products of integer-valued doubles, saturated to 64 bits."""
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in c]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    return np.array([[clip(sum(a * b for a, b in zip(map(int, row), v, strict=True))) for v in exact] for row in q], dtype=np.int64).reshape(len(q), len(c))


def _scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (whole numbers as doubles) and length."""
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") * scale).alias("raw"))
    most = F.lit(sys.float_info.max)
    # From 2^52 on doubles are whole, and floor() would not hold the largest ones.
    whole = F.transform("raw", lambda x: F.when(F.abs(x) < float(2**52), F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, most), -most)))
    return rows.select("id", whole.alias("v")).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


class Block:
    """A block's candidates by falling length."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        lengths = _length(vectors)
        order = np.argsort(-lengths, kind="stable")
        self.c, self.ids, self.lengths = vectors[order], ids[order], lengths[order]
        # The lowest local threshold at which coordinates have paid, and the highest at which they haven't.
        self.steep, self.failed = math.inf, -math.inf
        self._columns = self._squares = None

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Components and their squares, a row a coordinate."""
        if self._columns is None:
            self._columns = np.ascontiguousarray(self.c.T)
            self._squares = self._columns**2
        return self._columns, self._squares

    def near(self, q: np.ndarray, ql: float, least: float, reach: int) -> np.ndarray:
        """Of the first reach candidates, those that the strongest coordinates allow to reach the score."""
        columns, squares = self.columns()
        at = np.argpartition(-np.abs(q), min(FOCUS, len(q)) - 1)[:FOCUS]
        rest = math.sqrt(max(0.0, ql * ql - float(q[at] @ q[at])))
        others = np.sqrt(np.maximum(self.lengths[:reach] ** 2 - squares[at, :reach].sum(axis=0), 0.0))
        slack = 1e-9 * ql * float(self.lengths[0]) + 1e-9
        return np.flatnonzero(q[at] @ columns[at, :reach] + rest * others >= least - slack)

    def measure(self, q: np.ndarray, ql: np.ndarray, least: np.ndarray, cosine: np.ndarray, reach: np.ndarray) -> None:
        """Settle whether coordinates pay at thresholds that nothing is known of yet, from the highest down."""
        order = np.argsort(-cosine, kind="stable")
        for i in order[np.unique(np.linspace(0, len(order) - 1, PROBES).astype(int))]:
            if not 0 < cosine[i] <= 1 or len(self.near(q[i], ql[i], least[i], int(reach[i]))) > WORTH * reach[i]:
                self.failed = float(cosine[i])
                break
            self.steep = float(cosine[i])


def search_block(q: np.ndarray, q_id: np.ndarray, least: np.ndarray, block: Block, k: int, tally: list[int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """The up to k best candidates of each query in a block that reach the query's least score. tally: adds up pairs, and pairs whose whole product was taken."""
    q, c = _fit(q, block.c)
    if c is not block.c:
        block.c, block._columns = c, None
    ql, cl = _length(q), block.lengths
    bound = float(ql.max(initial=0) * cl.max(initial=0))
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    slack, done = 1e-9, 0
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(ql * cl[0] > 0, least / (ql * cl[0]), np.where(least > 0, np.inf, -np.inf))
        shortest = np.where(ql > 0, least / ql, np.where(least > 0, np.inf, -np.inf))
    reach = np.searchsorted(-cl, -(shortest * (1 - slack)) + slack, side="right")
    reach[least <= 0] = len(c)
    alive = (cosine <= 1 + slack) & (reach > 0)
    exact = bound < EXACT
    unknown = alive & (cosine > block.failed) & (cosine < block.steep)
    if exact and unknown.any():
        block.measure(q[unknown], ql[unknown], least[unknown], cosine[unknown], reach[unknown])
    steep = alive & exact & (cosine >= block.steep)
    flat = np.flatnonzero(alive & ~steep)
    for lo in range(0, len(flat), 64):
        rows = flat[lo : lo + 64]
        upto = int(reach[rows].max())
        scores = _products(q[rows], c[:upto], bound)
        done += int(reach[rows].sum())
        for i, s in zip(rows, scores, strict=True):
            _keep(out, q_id[i], least[i], s[: reach[i]], block.ids[: reach[i]], k)
    for i in np.flatnonzero(steep):
        at = block.near(q[i], float(ql[i]), float(least[i]), int(reach[i]))
        done += len(at)
        if len(at):
            _keep(out, q_id[i], least[i], _products(q[i : i + 1], c[at], bound)[0], block.ids[at], k)
    if tally is not None:
        tally[0] += len(q) * len(c)
        tally[1] += done
    return out


def _keep(out: tuple[list, list, list], query: int, least: float, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    ok = np.flatnonzero((ids != query) & (scores >= least))
    if len(ok) > k:
        # all that tie with the k-th stay for the order by id
        ok = ok[scores[ok] >= np.partition(scores[ok], len(ok) - k)[len(ok) - k]]
    order = ok[np.lexsort((ids[ok], -scores[ok]))][:k]
    out[0].extend([int(query)] * len(order))
    out[1].extend(ids[order].tolist())
    out[2].extend(scores[order].tolist())


def _vectors(column: pa.ListArray) -> np.ndarray:
    """A list column as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query. queries: a condition on the column "id"."""
    best = found(vectors, queries, k, id_col, vector_col, scale).where("query_id is not null")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def verified_share(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> float:
    """Of all pairs of a query and a candidate, the share whose whole product is taken; the others are pruned."""
    rows = _scaled(vectors, id_col, vector_col, scale)
    pairs = rows.count() * rows.where(queries).select("id").distinct().count()
    counted = found(vectors, queries, k, id_col, vector_col, scale).where("query_id is null").agg(F.sum("score")).first()[0] or 0
    return counted / pairs if pairs else 0.0


def found(vectors: DataFrame, queries, k: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """query_id, vec_id, score of what the blocks give out; rows without a query count the products taken, as score."""
    spark = vectors.sparkSession
    rows = common.materialize(_scaled(vectors, id_col, vector_col, scale))
    schema = "query_id long, vec_id long, score long"
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], schema)
    fit = lambda components: max(1, components // max(1, width))
    asked = rows.where(queries).groupBy("id").agg(F.min(F.struct("v", "length")).alias("q")).select("id", "q.*")
    seeds = rows.orderBy(F.desc("length"), "id").limit(fit(SEEDS)).select("id", "v").collect()
    seed_id, seed = np.array([r.id for r in seeds], dtype=np.int64), _pad([r.v for r in seeds])

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = batch.column(0).to_numpy(), _vectors(batch.column(1))
            a, b = _fit(vs, seed)
            la, lb = _length(a), _length(b)
            least = []
            for lo in range(0, len(a), 256):
                scores = _products(a[lo : lo + 256], b, float(la.max(initial=0) * lb.max(initial=0)))
                for i, row in zip(ids[lo : lo + 256], scores, strict=True):
                    other = row[seed_id != i]
                    least.append(float(np.partition(other, len(other) - k)[len(other) - k]) if len(other) >= k else -math.inf)
            # as a double the score may be rounded up beyond 2^53
            least = [x if abs(x) < EXACT else float(np.nextafter(np.nextafter(x, -math.inf), -math.inf)) for x in least]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(least, pa.float64())], names=["id", "v", "length", "least"])

    asked = asked.mapInArrow(first_scores, "id long, v array<double>, length double, least double")
    # The least length of a result; a query that anything may answer comes first.
    need = F.when(F.col("least") <= 0, F.lit(-1.0)).when(F.col("length") > 0, F.col("least") / F.col("length")).otherwise(F.lit(float("inf")))
    in_order = asked.withColumn("need", need).repartitionByRange("need", "id").sortWithinPartitions("need", "id")
    chunk = F.floor(F.monotonically_increasing_id() / fit(CHUNK))
    packed = common.materialize(in_order.withColumn("chunk", chunk).groupBy("chunk").agg(F.collect_list(F.struct("id", "least", "v")).alias("items"), F.min("need").alias("need")))

    # Limits between buckets from quantiles of the lengths; equal lengths share a bucket, however many they are.
    limits = sorted(set(rows.approxQuantile("length", [i / BUCKETS for i in range(1, BUCKETS)], 0.2 / BUCKETS)))
    placed = rows.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col("length"))) if limits else F.lit(0))
    # A row a bucket.
    sizes = sorted(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top")).collect())
    parts = [max(1, math.ceil(2 * r.n / fit(BLOCK))) if r.n > fit(BLOCK) else 1 for r in sizes]
    tops = spark.createDataFrame([(r.bucket, sum(parts[:i]), parts[i], float(r.top)) for i, r in enumerate(sizes)], "bucket int, first long, parts long, top double")
    placed = placed.join(F.broadcast(tops), "bucket").withColumn("block", F.col("first") + F.pmod(F.xxhash64(F.lit(2), "id", "v"), F.col("parts")))
    cands = placed.select("block", F.lit(-1).cast("long").alias("chunk"), F.array(F.struct("id", F.lit(0.0).alias("least"), "v")).alias("items"))
    # A chunk goes to a bucket's blocks only where lengths allow one of its scores.
    visits = packed.join(F.broadcast(tops), F.col("top") * (1 + 1e-9) + 1e-9 >= F.col("need")).select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block"), "chunk", "items"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready, tally = None, [], None, [0, 0]
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            numbers, chunks, items = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            starts = items.offsets.to_numpy() - items.offsets[0].as_py()
            each = items.flatten()
            ids, least, lists = each.field("id").to_numpy(), each.field("least").to_numpy(), each.field("v")
            if len(lists) != len(ids):
                raise ValueError("lists and ids differ in number")
            # Runs of a block's candidates, and single chunks.
            cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (chunks[1:] >= 0)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if numbers[lo] != block:
                    block, held, ready = numbers[lo], [], None
                a, b = int(starts[lo]), int(starts[hi])
                part = ids[a:b], _vectors(lists.slice(a, b - a))
                if chunks[lo] < 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        width = max(v.shape[1] for _, v in held)
                        ready = Block(np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held]), np.concatenate([i for i, _ in held]))
                    for o, x in zip(out, search_block(part[1], part[0], least[a:b], ready, k, tally), strict=True):
                        o.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([tally[0]], pa.int64()), pa.array([tally[1]], pa.int64())], names=["query_id", "vec_id", "score"])

    tasks = min(sum(parts), TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = cands.unionByName(visits).repartition(tasks, "block").sortWithinPartitions("block", "chunk")
    return met.mapInArrow(search, schema)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of each query, the rows whose vec_id is divisible by 100."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {"op10_topk": op10_topk}
ORACLES = {
    "op10_topk": """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
