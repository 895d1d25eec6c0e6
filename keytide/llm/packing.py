"""Best-fit packing: documents as token ids into as few sequences of a fixed capacity as possible.

Only the histogram of piece lengths, at most CAPACITY numbers, reaches the driver. The configuration program, in which
every way of filling a sequence (a configuration) has a number of times and every length must be covered as often as it
has pieces, is solved as a fraction by multiplicative weights: a length's price falls with the share of its pieces that is
covered beyond the phase's goal, and the best completion of a sequence at the current prices comes from a knapsack
table by dynamic programming. The prices also give a bound below which no plan can be. The solution is then rounded: of
the configurations that cost no more than the bound allows, whole times first, then by lot in proportion to what is left
of them, as long as their pieces last. What remains is solved and rounded again, and when it is a small share, or
rounding finds no more, best fit in falling length places it in the room of the rounded plan and in new sequences.

Pieces then find their places without meeting: a piece's rank among those of its length is the number before its group
(of a length and a salt, of which a length has one for every GROUP pieces) plus its row number in the group, and the plan
says which sequence and offset a rank has.

Texts are tokenized by the whole tokenizer, or, where it is the known word tokenizer and a text has common characters
only, word by word: distinct words of many texts at a time, whose ids a worker remembers.

Defined cases: a null text is an empty one, a single separator; a null id is an id like any other; repeated rows are
packed each for itself; a very long text is read in parts that end between words; pieces of equal length are placed in
any order; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import functools
import json
import math
import os
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: The id that ends a document.
SEPARATOR = 0
#: Phases of the fractional solution, and how fast prices fall with the share covered.
PHASES, RATE = 10, 0.3
#: A configuration is rounded if its price is at least this share of the best one's; best fit gets this share of the pieces, or what a round that places less than LEAST of them leaves.
TIGHT, RESIDUE, LEAST = 0.9995, 0.1, 0.01
#: Words and characters whose ids a worker remembers (about 100 MB), and characters tokenized at a time.
CACHE, CACHE_CHARS, TAKE = 500_000, 8_000_000, 2_000_000
#: Pieces in a group of one length and salt, about, and groups that are broadcast at most.
GROUP, MAX_BROADCAST_GROUPS = 5000, 100_000

#: Texts of these characters alone are already in composed form and lower-case and split alike here and in the tokenizer.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\\|")
#: The same for ASCII.
_PLAIN = bytes([*range(9, 14), *range(32, 127)])
#: Fixed value: the known tokenizer's split into words, for such texts in lower case.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Fixed value: what the known tokenizer does to a text before it splits words into ids.
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_GAP = re.compile(r"\s")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_into_words(path: str) -> bool:
    """Whether a tokenizer's file says that it composes, lower-cases and splits as the word-by-word way does."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normal, before = (said.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1].get("pattern") == {"Regex": "\\s+"}
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": _KNOWN_PATTERN}
        and not parts[1].get("add_prefix_space")
        and all(x["content"].startswith("<|") for x in said.get("added_tokens", []))
    )


class Tokens:
    """Ids of texts, by any tokenizer; remembers those of words if the tokenizer is one that splits_into_words()."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._by_words = splits_into_words(path)
        # For words that are composed, in lower case and split already.
        self._of_words = Tokenizer.from_file(path)
        self._of_words.normalizer = normalizers.Sequence([])
        self._of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        """Known words' numbers; number i has the ids from _first[i] to _first[i + 1] of _ids."""
        self._number: dict[str, int] = {}
        self._ids, self._first = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 16, dtype=np.int64)
        self._chars = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self._number), int(self._first[len(self._number)])
        while n + len(words) + 1 > len(self._first):
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
        while at + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[at : at + len(ids)] = ids
        self._first[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        self._number.update(zip(words, range(n, n + len(words)), strict=True))
        self._chars += sum(map(len, words))

    def _learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 64):  # the tokenizer is fastest on short texts
            part = words[lo : lo + 64]
            found = self._of_words.encode(" ".join(part), add_special_tokens=False)
            ids, of = np.array(found.ids, dtype="<u4"), np.array(found.word_ids, dtype=np.int64)
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
            if len(starts) == len(part):
                self._add(part, ids, np.diff(starts, append=len(ids)))
            else:
                each = [self.whole(w) for w in part]
                self._add(part, np.concatenate(each), np.array(list(map(len, each))))

    @staticmethod
    def _common(text: str) -> bool:
        """Whether a text may be read word by word."""
        return not (text.encode().translate(None, _PLAIN) or "<|" in text if text.isascii() else _OTHER.search(text))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        before: list[np.ndarray] = []
        for last, ids in self._parts(texts):
            before.append(ids)
            if last:
                yield np.concatenate(before)
                before = []

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[bool, np.ndarray]]:
        """The ids of the texts' parts, and whether a part ends its text."""
        held: list[tuple[bool, str]] = []
        size = 0
        for text in texts:
            t, at = text or "", 0
            if not (self._by_words and self._common(t)):
                yield from self._read(held)
                held, size = [], 0
                yield True, self.whole(t)
                continue
            while at < len(t) or not t:
                gap = _GAP.search(t, at + TAKE) if len(t) - at > TAKE else None
                end = gap.start() if gap else len(t)
                held.append((end == len(t), t[at:end]))
                size, at = size + end - at, end
                if size >= TAKE:
                    yield from self._read(held)
                    held, size = [], 0
                if not t:
                    break
        yield from self._read(held)

    def _read(self, held: list[tuple[bool, str]]) -> list[tuple[bool, np.ndarray]]:
        if len(self._number) > CACHE or self._chars > CACHE_CHARS:
            self._forget()
        words = [_SPLIT.findall(t.lower()) for _, t in held]
        ends = np.cumsum([0, *map(len, words)])
        coded = pa.array([w for x in words for w in x], pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self._number])
        number = np.fromiter(map(self._number.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        at = number[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, dtype=np.int64)
        first = self._first[at]
        sizes = self._first[at + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = upto[ends]
        return [(last, ids[a:b]) for (last, _), a, b in zip(held, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    end = np.array([SEPARATOR], dtype="<u4")

    def make():
        known = tokens(tokenizer)

        def f(x: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(x["id"], known.encode(x["text"]), strict=True):
                data = memoryview(np.concatenate([ids, end]).tobytes())
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for k, v in (("doc_id", doc_id), ("piece", i), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[k].append(v)
            return out

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.map_rows(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


Plan = list[tuple[dict[int, int], int]]  # (pieces of each length in a sequence, number of such sequences)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY, opened: Plan = ()) -> Plan:
    """Best fit in falling length over a histogram, into the room of the opened sequences and new ones: sequences that look alike are handled together."""
    bins: dict[int, list[list]] = {}  # room -> [contents, number]
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    done: list[tuple[tuple, int]] = []

    def put(room: int, content: tuple, number: int) -> None:
        if room == 0:
            done.append((content, number))
        elif number:
            bins.setdefault(room, []).append([content, number])
            rooms[room] += number

    for content, number in opened:
        put(capacity - sum(x * n for x, n in content.items()), tuple(content.items()), number)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                full, rest = divmod(left, each)
                put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = int(fits[0]) + length
            content, number = bins[room].pop()
            rooms[room] -= number
            each = room // length
            full = min(number, left // each)
            put(room - each * length, (*content, (length, each)), full)
            left -= full * each
            number -= full
            if number and 0 < left < each:
                put(room - left * length, (*content, (length, left)), 1)
                number, left = number - 1, 0
            if number:
                put(room, content, number)
    done += [(c, n) for same in bins.values() for c, n in same]
    return [(_summed(c), n) for c, n in done if n]


def _summed(content: tuple) -> dict[int, int]:
    out: dict[int, int] = {}
    for length, number in content:
        out[length] = out.get(length, 0) + number
    return out


def best_values(prices: np.ndarray) -> np.ndarray:
    """The knapsack table: at capacity - c the best price of pieces that fill at most c, for c from 0; prices by length, -inf where there is none."""
    capacity = len(prices) - 1
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        at = capacity - c
        best[at] = max(best[at + 1], (prices[1 : c + 1] + best[at + 1 :]).max())
    return best


def completed(first: int, prices: np.ndarray, best: np.ndarray, most: dict[int, int]) -> dict[int, int]:
    """The filling that starts with a piece and goes on with the best of the table at the current prices, with at most so many pieces of each length."""
    capacity = len(prices) - 1
    out, room, spent = {first: 1}, capacity - first, []

    def spend(length: int) -> None:
        if out[length] >= most[length]:
            spent.append((length, prices[length]))
            prices[length] = -np.inf

    spend(first)
    while room:
        worth = prices[1 : room + 1] + best[capacity - room + 1 :]
        length = int(worth.argmax()) + 1
        if not prices[length] > 0:
            break
        out[length] = out.get(length, 0) + 1
        room -= length
        spend(length)
    for length, price in spent:
        prices[length] = price
    return out


Fraction = dict[tuple[tuple[int, int], ...], float]  # how many times each configuration, as (length, pieces) pairs


def fractional(counts: dict[int, int], capacity: int = CAPACITY, phases: int = PHASES) -> tuple[Fraction, float, np.ndarray, float]:
    """A fractional solution that covers all counts, a bound below which no solution can be, and the prices and the best configuration's price that prove it.

    In each phase every length is covered by another 1 / phases of its pieces; a configuration's step is what its
    scarcest length still needs, or half a phase's share of it, and a length a phase ahead has no price.
    """
    most = np.zeros(capacity + 1)
    most[list(counts)] = list(counts.values())
    live = np.flatnonzero(most)
    size, share, covered = np.arange(capacity + 1) / capacity, 1 / phases, np.zeros(capacity + 1)
    out: Fraction = {}
    bound, proof = 0.0, (size, 1.0)
    price = lambda length, done: size[length] * np.exp(-RATE * (done - goal + share))
    for phase in range(1, phases + 1):
        goal = phase * share
        prices = np.full(capacity + 1, -np.inf)
        prices[live] = price(live, covered[live] / most[live])
        best = best_values(prices)
        if (b := float(most[live] @ prices[live] / best[0])) > bound:
            bound, proof = b, (prices.copy(), float(best[0]))
        prices[live[covered[live] / most[live] >= goal + share - 1e-9]] = -np.inf
        for first in live[::-1].tolist():
            while covered[first] < goal * most[first] - 1e-9:
                found = completed(first, prices, best, counts)
                step = min(max(goal * most[x] - covered[x], 0.5 * share * most[x]) / n for x, n in found.items())
                key = tuple(sorted(found.items()))
                out[key] = out.get(key, 0.0) + step
                for x, n in found.items():
                    covered[x] += n * step
                    done = covered[x] / most[x]
                    prices[x] = -np.inf if done >= goal + share - 1e-9 else price(x, done)
    return out, bound, *proof


def rounded(found: Fraction, left: Counter, lot: random.Random) -> Plan:
    """Configurations a whole number of times, while their pieces last, which are taken from left."""
    plan: Plan = []

    def take(key: tuple[tuple[int, int], ...], times: int) -> None:
        times = min(times, *(left[x] // n for x, n in key))
        if times > 0:
            plan.append((dict(key), times))
            for x, n in key:
                left[x] -= n * times

    falling = sorted(found, key=lambda k: (-found[k], k))
    for key in falling:
        take(key, int(found[key]))
    chance = {key: part for key in falling if (part := found[key] % 1) > 0}
    for key in sorted(chance, key=lambda k: -(lot.random() ** (1 / chance[k]))):
        take(key, 1)
    return plan


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, Counter, float]:
    """The rounded part of a plan, the pieces that are left, and the bound on sequences."""
    left, total, lot = Counter({x: n for x, n in counts.items() if n}), sum(counts.values()), random.Random(0)
    plan: Plan = []
    bound, placed = 0.0, total
    while left.total() > RESIDUE * total and placed >= LEAST * total:
        found, low, prices, top = fractional({x: n for x, n in left.items() if n}, capacity)
        bound = bound or low
        tight = {k: v for k, v in found.items() if sum(prices[x] * n for x, n in k) >= TIGHT * top}
        before = left.total()
        plan += rounded(tight, left, lot)
        placed = before - left.total()
    return plan, +left, bound


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan that places every piece of the histogram."""
    full = {x: n for x, n in counts.items() if x == capacity and n}
    plan, left, _ = configurations({x: n for x, n in counts.items() if x < capacity and n}, capacity)
    return [({x: 1}, n) for x, n in full.items()] + best_fit(left, capacity, plan)


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by the first rank of a run of ranks: that rank, first sequence, pieces in a sequence, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for content, number in plan:
        offset = 0
        for length in sorted(content, reverse=True):
            each = content[length]
            runs.setdefault(length, []).append((used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + each * number
            offset += each * length
        sequence += number
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with a column length) with sequence_id and offset."""
    spark = rows.sparkSession
    kept = common.materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r.length: r["count"] for r in kept.groupBy("length").count().collect()}
    if not counts:
        return kept.select(*rows.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # At most as many rows as there are lengths.
    salts = [(int(x), math.ceil(n / GROUP)) for x, n in counts.items()]
    salted = kept.join(F.broadcast(spark.createDataFrame(salts, "length long, _salts long")), "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = groups.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    if sum(n for _, n in salts) <= MAX_BROADCAST_GROUPS:
        before = F.broadcast(before)
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("_row")) - 1).join(before, ["length", "_salt"])
    plan = spark.sparkContext.broadcast(places(solve(counts, capacity)))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_at").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for at in np.split(order, cuts[1:]):
                x = int(length[at[0]]) if len(at) else 0
                first, base, each, start = plan.value[x]
                run = np.searchsorted(first, rank[at], side="right") - 1
                j = rank[at] - first[run]
                sequence[at] = base[run] + j // each[run]
                offset[at] = start[run] + (j % each[run]) * x
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_at")).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity), capacity)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_pack": op9_pack}
ORACLES: dict[str, str] = {}
