"""URL filters: host rules, and for the rest the ratio of two character language models.

Rules decide the urls they fit. The urls that allow and block rules decide are the accepted and rejected examples from
which two variable-order Markov models learn: over the bytes of a url, every context of up to ORDER bytes that occurs in
an example has the counts of the bytes that follow it, and a byte's probability is interpolated from the longest known
context to the shortest by the share of new bytes that each has met (Witten and Bell). A url's score is the mean
log-likelihood difference of its bytes, rejected less accepted, and it is blocked above a threshold calibrated on hosts
held out of the counting.

The tables of contexts and of what follows them grow with the examples; they are keyed by 64-bit hashes and stay
distributed. Urls meet them as broadcast sorted arrays only while a count says that there are at most MAX_BROADCAST
entries; beyond that every url's contexts are looked up by a join, with the same scores. Counts are summed in each batch
before they are shuffled.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is scored as a text, an
empty one being allowed; a very long url is read whole; no two rules of one length fit the same url, else the first
given would count; without examples of both kinds every url without a rule is allowed, and without held-out ones of both
the threshold is 0; repeated rows are judged each for itself; an empty table gives an empty result; further columns play
no part.
"""

from __future__ import annotations

import dataclasses
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (rule, verdict): the part before the first "/" is a host, the rest a path's start.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Bytes of the longest context.
ORDER = 6
#: One example's host in so many calibrates instead of counting.
FOLDS = 5
#: Entries of the tables that are broadcast at most: 80 MB.
MAX_BROADCAST = 1 << 21
#: Bins of the calibration's histograms, over scores from -LIMIT to LIMIT.
BINS, LIMIT = 2000, 10.0
#: Urls read at a time.
TAKE = 5000

_SCHEMA_GRAMS = "bad int, context long, gram long, n long"


def hashes(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each url, one after another, the hash of the 0 to ORDER + 1 bytes that end before the next (a row a length, marks for what is before the text included), and each url's number of bytes."""
    data = [(u or "").encode("utf-8", "replace") for u in urls]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    # Every url stands behind ORDER + 1 marks, of which the last is the context of its first byte.
    lead = ORDER + 1
    text = np.zeros(int(sizes.sum()) + lead * len(data), dtype=np.uint64)
    starts = np.cumsum(sizes + lead) - sizes
    real = np.ones(len(text), dtype=bool)
    for i in range(lead):
        real[starts - 1 - i] = False
    text[real] = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(real)
    out = np.empty((ORDER + 2, len(at)), dtype=np.uint64)
    out[0] = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 2):
            h = (out[k - 1] ^ (text[at - (k - 1)] + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
            out[k] = h ^ (h >> np.uint64(29))
    return out, sizes


def pairs(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the contexts (a row a length from 0 to ORDER) and of the grams, context and byte, at each byte, and each url's number of bytes."""
    grams, sizes = hashes(urls)
    # A context is what the byte before ends with; before the first byte there are marks alone.
    before = np.empty((ORDER + 1, grams.shape[1]), dtype=np.uint64)
    before[:, 1:] = grams[: ORDER + 1, :-1]
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    marks = np.empty(ORDER + 1, dtype=np.uint64)
    marks[0] = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            h = (marks[k - 1] ^ np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
            marks[k] = h ^ (h >> np.uint64(29))
    before[:, firsts] = marks[:, None]
    return before.view(np.int64), grams[1:].view(np.int64), sizes


def probabilities(n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """P(byte | context) from, by a row a context length, how often the byte followed, how often any did, and how many kinds did."""
    p = np.full(n.shape[1], 1 / 256)
    for k in range(len(n)):
        p = np.where(total[k] > 0, (n[k] + kinds[k] * p) / np.maximum(total[k] + kinds[k], 1), p)
    return p


def _means(ratio: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of each url's part; 0 for an empty one."""
    ends = np.cumsum(sizes)
    run = np.concatenate([[0.0], np.cumsum(ratio)])
    return (run[ends] - run[ends - sizes]) / np.maximum(sizes, 1)


@dataclasses.dataclass
class Tables:
    """What follows which context: frames grams (gram, n0, n1) and contexts (context, t0, k0, t1, k1), of which 0 is accepted and 1 rejected, and how many rows they have."""

    grams: DataFrame
    contexts: DataFrame
    entries: int


class Arrays:
    """The tables as sorted arrays."""

    def __init__(self, tables: Tables):
        grams, contexts = tables.grams.toArrow().sort_by("gram"), tables.contexts.toArrow().sort_by("context")
        self.gram, self.context = grams.column("gram").to_numpy(), contexts.column("context").to_numpy()
        self.n = np.stack([grams.column(f"n{y}").to_numpy() for y in (0, 1)])
        self.total = np.stack([contexts.column(f"t{y}").to_numpy() for y in (0, 1)])
        self.kinds = np.stack([contexts.column(f"k{y}").to_numpy() for y in (0, 1)])

    @staticmethod
    def _find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
        return at, table[at] == asked

    def scores(self, urls: list[str | None]) -> np.ndarray:
        contexts, grams, sizes = pairs(urls)
        (g, known), (c, met) = self._find(self.gram, grams), self._find(self.context, contexts)
        p = [probabilities(np.where(known, self.n[y][g], 0), np.where(met, self.total[y][c], 0), np.where(met, self.kinds[y][c], 0)) for y in (0, 1)]
        return _means(np.log(p[1]) - np.log(p[0]), sizes)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, url, host, path, and the longest rule that fits with its verdict, else nulls."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule = said = None
    for text, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + start)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        said = F.when(fits, F.lit(verdict)) if said is None else said.when(fits, F.lit(verdict))
    return rows.withColumns({"rule": rule, "ruling": said})


def count(examples: DataFrame) -> Tables:
    """The tables of examples (url, bad)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches, TAKE):
            urls, bad = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for y in (0, 1):
                contexts, grams, _ = pairs([u for u, b in zip(urls, bad, strict=True) if b == y])
                found, first, n = np.unique(grams.ravel(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), y, dtype=np.int32)), pa.array(contexts.ravel()[first]), pa.array(found), pa.array(n.astype(np.int64))], names=["bad", "context", "gram", "n"])

    sums = examples.select("url", "bad").mapInArrow(run, _SCHEMA_GRAMS).groupBy("gram").agg(
        F.first("context").alias("context"), *[F.sum(F.when(F.col("bad") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    )
    grams = common.materialize(sums)
    each = [x for y in (0, 1) for x in (F.sum(f"n{y}").alias(f"t{y}"), F.count_if(F.col(f"n{y}") > 0).alias(f"k{y}"))]
    contexts = common.materialize(grams.groupBy("context").agg(*each))
    return Tables(grams.select("gram", "n0", "n1"), contexts, grams.count() + contexts.count())


def learn(rows: DataFrame) -> tuple[Tables, float] | None:
    """The tables and the threshold, from rows of ruled(); None without examples of both kinds."""
    examples = rows.where("ruling is not null").select("url", (F.col("ruling") == "block").cast("int").alias("bad"), held_out().alias("held"))
    tables = count(examples.where("not held"))
    if not all(tables.grams.agg(F.sum("n0"), F.sum("n1")).first()):
        return None
    bin_ = F.floor((F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) + LIMIT) * (BINS / (2 * LIMIT))).cast("int")
    held = scored(examples.where("held"), tables).groupBy("bad", bin_.alias("bin")).count().collect()
    shares = np.zeros((2, BINS + 1))
    for r in held:
        shares[r.bad, r.bin] += r["count"]
    if not shares.sum(axis=1).all():
        return tables, 0.0
    shares /= shares.sum(axis=1, keepdims=True)
    # Blocking from a bin on: right on the bad above it and on the good below it; in the middle of the best bins.
    right = np.cumsum(shares[0])[:-1] + (1 - np.cumsum(shares[1])[:-1])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return tables, float((best.mean() + 1) * (2 * LIMIT / BINS) - LIMIT)


def held_out() -> Column:
    """Whether a row's host calibrates."""
    return F.crc32(F.col("host").cast("binary")) % FOLDS == 0


def scored(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows (with a column url) with the score of their url."""
    if tables.entries > MAX_BROADCAST:
        return _scored_by_join(rows, tables)
    held = rows.sparkSession.sparkContext.broadcast(Arrays(tables))

    @F.pandas_udf("double")
    def score(urls):
        import pandas as pd

        known = [u if isinstance(u, str) else None for u in urls]
        parts = [held.value.scores(known[lo : lo + TAKE]) for lo in range(0, len(known), TAKE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return rows.withColumn("score", score(F.col("url")))


def _scored_by_join(rows: DataFrame, tables: Tables) -> DataFrame:
    """Each distinct url's contexts and grams meet the tables in a join, and their numbers come back to it."""
    urls = common.materialize(rows.where("url is not null").select("url").distinct().withColumn("_id", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches, 200):
            contexts, grams, sizes = pairs(batch.column(0).to_pylist())
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids = np.repeat(batch.column(1).to_numpy(), sizes)
            for kind, x in ((0, contexts), (1, grams)):
                for k in range(ORDER + 1):
                    slot = (place * (ORDER + 1) + k) * 2 + kind
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(slot), pa.array(x[k])], names=["_id", "slot", "key"])

    zero = F.lit(0).cast("long")
    grams = tables.grams.select(F.col("gram").alias("key"), F.lit(1).alias("kind"), F.array("n0", zero, "n1", zero).alias("x"))
    contexts = tables.contexts.select(F.col("context").alias("key"), F.lit(0).alias("kind"), F.array("t0", "k0", "t1", "k1").alias("x"))
    asked = urls.select("url", "_id").mapInArrow(ask, "_id long, slot long, key long").withColumn("kind", (F.col("slot") % 2).cast("int"))
    told = asked.join(contexts.unionByName(grams), ["key", "kind"]).groupBy("_id").agg(F.collect_list(F.struct("slot", "x")).alias("told"))
    met = urls.join(told, "_id", "left").select("url", F.col("told.slot").alias("slots"), F.flatten("told.x").alias("numbers"))

    def reckon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches, 200):
            out = []
            for url, slots, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size = len(url.encode("utf-8", "replace"))
                x = np.zeros((size * (ORDER + 1) * 2, 4))
                if slots:
                    x[slots] = np.array(numbers).reshape(-1, 4)
                x = x.reshape(size, ORDER + 1, 2, 4)
                p = [probabilities(x[:, :, 1, 2 * y].T, x[:, :, 0, 2 * y].T, x[:, :, 0, 2 * y + 1].T) for y in (0, 1)]
                out.append(float(_means(np.log(p[1]) - np.log(p[0]), np.array([size]))[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["_url", "_score"])

    scores = met.mapInArrow(reckon, "_url string, _score double")
    return rows.join(scores, F.col("url") == F.col("_url"), "left").withColumn("score", F.coalesce("_score", F.lit(0.0))).drop("_url", "_score")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    rows = ruled(pages, id_col, url_col, rules)
    learnt = learn(rows)
    if learnt is None:
        out = rows.withColumns({"score": F.lit(0.0), "threshold": F.lit(0.0)})
    else:
        out = scored(rows, learnt[0]).withColumn("threshold", F.lit(learnt[1]))
    # An empty text gives no evidence against it.
    bad = (F.col("score") > F.col("threshold")) & (F.length(F.coalesce("url", F.lit(""))) > 0)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score", "threshold")


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return judge(common.table(spark, sf_dir, "pages"))


QUERIES = {"op5_urlfilter": op5_urlfilter}
ORACLES: dict[str, str] = {}
