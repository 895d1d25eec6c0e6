"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words.

A paragraph is a line. A section ends with an empty line, or with a paragraph whose digest says so, so that an insertion
moves no later section's bounds. A leaf is a run of at most three words of a paragraph, its end given by its own last bytes.
Together the leaves hold every byte of the text, each inner digest covers its children's, and the fingerprint is the
root's digest: equal roots mean equal texts. Two trees are compared from the top: equal roots end it, equal sections and
paragraphs count whole, and only what differs is compared by leaves. The likeness is twice the bytes under equal
branches over the bytes of both texts; the first leaf that differs locates an edit.

The next document of each document needs no global order in one task: ids are cut into ranges, each range is sorted in
its own partition, and the first document of a range is also sent to the range before it. Rows without an id, or of an id
that many rows have, are cut into ranges by the hash that orders them.

Defined cases: a null text is an empty one; two empty texts are alike (1), an empty and another are not (0); a very long
text is one tree, whose task holds it in memory, and so are the rows that repeat both id and text in one task; rows
without an id follow all others; rows with equal ids follow one another by a hash of their texts; the only row of a
table is its own next; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A paragraph ends its section if its digest's first byte is divisible by this.
SECTION = 8
#: Bytes of a leaf where no white space ends it.
RUN = 24


class Tree:
    """The Merkle tree of a text: leaves, paragraphs and sections with their digests, sizes in bytes and first children."""

    __slots__ = ("data", "leaves", "sizes", "paragraphs", "sections", "root")

    def __init__(self, text: str):
        self.data = data = text.encode("utf-8", "replace")
        raw = np.frombuffer(data, dtype=np.uint8)
        breaks = np.flatnonzero((raw == 10) | (raw == 32))
        # A line's end always ends a leaf; a space does for half of the endings of words.
        before, earlier = raw[np.maximum(breaks - 1, 0)].astype(np.int64), raw[np.maximum(breaks - 2, 0)].astype(np.int64)
        lines = raw[breaks] == 10
        kept = lines | (((before * 7 + earlier * 3) >> 1) % 2 == 0)
        # Where words go on without such an ending, every third ends a leaf.
        since = np.arange(len(kept)) - np.maximum.accumulate(np.where(kept, np.arange(len(kept)), -1)) if len(kept) else kept
        kept |= (since > 0) & (since % 3 == 0)
        ends = breaks[kept] + 1
        newline = lines[kept]
        if not len(ends) or ends[-1] != len(data):
            ends, newline = np.append(ends, len(data)), np.append(newline, False)
        if len(newline):
            newline[-1] = True
        sizes = np.diff(ends, prepend=0)
        if len(sizes) and sizes.max() > 2 * RUN:
            # Runs without white space are cut at a fixed length.
            pieces = np.where(sizes > 2 * RUN, sizes // RUN, 1)
            of = np.repeat(np.arange(len(ends)), pieces)
            back = np.repeat(np.cumsum(pieces), pieces) - 1 - np.arange(len(of))
            step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
            ends, newline = np.where(back == 0, ends[of], ends[of] - sizes[of] + step * RUN), newline[of] & (back == 0)
        bounds = [0, *ends.tolist()]
        digest = xxhash.xxh3_128_digest
        self.leaves = [digest(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        self.sizes = np.diff(bounds)
        last = (np.flatnonzero(newline) + 1).tolist()
        inner = lambda level, children: hashlib.blake2b(level + b"".join(children), digest_size=16).digest()
        self.paragraphs = [(inner(b"P", self.leaves[a:b]), a, b) for a, b in zip([0, *last], last, strict=False)]
        self.sections: list[tuple[bytes, int, int]] = []
        start = 0
        for i, (p, a, b) in enumerate(self.paragraphs):
            empty = b - a == 1 and int(self.sizes[a]) <= 1
            if empty or p[0] % SECTION == 0 or i == len(self.paragraphs) - 1:
                self.sections.append((inner(b"S", [x[0] for x in self.paragraphs[start : i + 1]]), start, i + 1))
                start = i + 1
        self.root = inner(b"D", [x[0] for x in self.sections])

    def fingerprint(self) -> str:
        return self.root.hex()

    def _leaf_range(self, section: tuple[bytes, int, int]) -> tuple[int, int]:
        return self.paragraphs[section[1]][1], self.paragraphs[section[2] - 1][2]


def _unmatched(a: list, b: list) -> tuple[list, list, list]:
    """Of two lists of branches (digest first): pairs with equal digests, and the rest of each."""
    theirs = Counter(x[0] for x in b)
    same, rest_a = [], []
    for x in a:
        if theirs.get(x[0], 0):
            theirs[x[0]] -= 1
            same.append(x)
        else:
            rest_a.append(x)
    ours = Counter(x[0] for x in same)
    rest_b = []
    for x in b:
        if ours.get(x[0], 0):
            ours[x[0]] -= 1
        else:
            rest_b.append(x)
    return same, rest_a, rest_b


def likeness(a: Tree, b: Tree) -> float:
    """Twice the bytes under equal branches over all bytes, from 0 to 1; 1 only for equal texts or reordered ones."""
    if a.root == b.root:
        return 1.0
    total = len(a.data) + len(b.data)
    run = np.concatenate([[0], np.cumsum(a.sizes)])
    same, sections_a, sections_b = _unmatched(a.sections, b.sections)
    common_bytes = sum(int(run[hi] - run[lo]) for lo, hi in map(a._leaf_range, same))
    paragraphs_a = [p for s in sections_a for p in a.paragraphs[s[1] : s[2]]]
    paragraphs_b = [p for s in sections_b for p in b.paragraphs[s[1] : s[2]]]
    same, paragraphs_a, paragraphs_b = _unmatched(paragraphs_a, paragraphs_b)
    common_bytes += sum(int(run[hi] - run[lo]) for _, lo, hi in same)
    left = Counter(x for _, lo, hi in paragraphs_b for x in b.leaves[lo:hi])
    if left:
        for _, lo, hi in paragraphs_a:
            for i in range(lo, hi):
                if left.get(a.leaves[i], 0):
                    left[a.leaves[i]] -= 1
                    common_bytes += int(a.sizes[i])
    return 2 * common_bytes / total


def first_difference(a: Tree, b: Tree) -> int | None:
    """Code points of a before the first leaf in which the texts differ; None for equal texts."""
    if a.root == b.root:
        return None
    at = p = 0
    for (x, _, end), (y, _, _) in zip(a.sections, b.sections, strict=False):  # equal sections are skipped whole
        if x != y:
            break
        p = end
    at = a.paragraphs[p][1] if p < len(a.paragraphs) else len(a.leaves)
    while at < min(len(a.leaves), len(b.leaves)) and a.leaves[at] == b.leaves[at]:
        at += 1
    return len(a.data[: int(a.sizes[:at].sum())].decode("utf-8", "ignore"))


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the following one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, tail, doc_id, text), dealt and sorted so that every row's next follows it in its partition; tail marks a copy of the next partition's first row that only serves as such."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known, anonymous = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    quantiles = sorted(int(x) for x in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else []
    limits = sorted(set(quantiles))
    # An id that several quantiles fall on has as many ranges of hashes, and so have the rows without one.
    spread = [quantiles.count(x) for x in limits]
    nameless = max(1, anonymous * parts // max(1, known + anonymous))
    h = F.xxhash64("text")
    slot = lambda n: F.least(F.floor((h / F.lit(2.0**64) + 0.5) * n), n - 1).cast("int")
    after = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col("doc_id"))) if limits else F.lit(0)
    own = F.try_element_at(F.array(*map(F.lit, spread)), after + 1) if limits else F.lit(None).cast("int")
    hot = (own > 1) & (F.try_element_at(F.array(*map(F.lit, limits)), after + 1) == F.col("doc_id")) if limits else F.lit(False)
    wide = max([nameless, *spread]) + 1
    # Rows without an id come last; in a range, the rows of its hot greatest id.
    part = F.when(F.col("doc_id").isNull(), F.lit((len(limits) + 1) * wide) + slot(F.lit(nameless))).otherwise(after * wide + F.when(hot, 1 + slot(own)).otherwise(0))
    keyed = rows.withColumns({"range": part, "anonymous": F.col("doc_id").isNull(), "h": h})
    order = F.struct("anonymous", "doc_id", "h")
    # One row a range.
    firsts = sorted((r.range, r.first) for r in keyed.groupBy("range").agg(F.min(order).alias("first")).collect())
    if not firsts:
        return keyed.select(F.lit(0).alias("part"), F.lit(False).alias("tail"), "doc_id", "text")
    numbers = spark.createDataFrame([(r, i) for i, (r, _) in enumerate(firsts)], "range int, part int")
    # The last part is followed by the first.
    goes = [(first.anonymous, first.doc_id, first.h, (i - 1) % len(firsts)) for i, (_, first) in enumerate(firsts)]
    small = spark.createDataFrame(goes, "f_anonymous boolean, f_id long, f_h long, serves int")
    same = (F.col("anonymous") == F.col("f_anonymous")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    marked = keyed.join(F.broadcast(numbers), "range").join(F.broadcast(small), same, "left")
    its_own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    serving = F.struct(F.col("serves").alias("part"), F.lit(True).alias("tail"))
    sent = marked.select("anonymous", "doc_id", "h", "text", F.explode(F.when(F.col("serves").isNull(), F.array(its_own)).otherwise(F.array(its_own, serving))).alias("to"))
    return sent.select("to.*", "anonymous", "doc_id", "h", "text").repartitionById(len(firsts), F.col("part")).sortWithinPartitions("part", "tail", "anonymous", "doc_id", "h").select("part", "tail", "doc_id", "text")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_sections", "n_paragraphs", "edit_from")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        waiting = None  # (part, doc_id, text, tree) of the row whose next is still to come
        for batch in common.cut(batches, common.BATCH_ROWS // 4):
            out: list[tuple] = []
            for part, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if tail and waiting is None:
                    continue  # a further copy
                tree = Tree(text)
                if waiting is not None:
                    _, before_id, before, t = waiting
                    new = edited(before, text)
                    e = Tree(new)
                    out.append((before_id, len(before), hashlib.sha256(e.data).hexdigest(), t.fingerprint(), e.fingerprint(), likeness(t, e), likeness(t, tree), len(t.sections), len(t.paragraphs), first_difference(t, e)))
                waiting = None if tail else (part, doc_id, text, tree)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=list(names))

    common.bound_batches(docs.sparkSession)
    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_paragraphs long, edit_from long")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document, compared with its edited text and the next document."""
    return compare(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprint": op3_fingerprint}
ORACLES: dict[str, str] = {}
