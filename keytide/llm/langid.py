"""Language identification by a linear-chain conditional random field over words.

A word's features are its character bigrams and trigrams with marks at both ends, its affixes of three letters, and,
for words of the training sample's lexicon, the word itself. Their weights and the weights of the transitions between
languages are learned together by the chains' likelihood, whose gradient is found by forward-backward. Training chains
are stretches of labelled documents, half of them joined from two languages, so that switches are learned as well.
Chains of WINDOW words cover the whole of a document; forward-backward gives each word its share of every language, and
a document has the language of the largest mean share, which is its score. A word's label is the language of its largest
share, and spans are a document's runs of words of one label.

The sample is bounded: of every language the FIT_ROWS documents with the smallest hashes of their ids, fewer of each
where there are more than WIDE languages, and of each document STRETCHES stretches of STRETCH words from anywhere in its
text. No language is left out. A run of more than LONG letters, as in scripts without spaces, counts as several words
of that length, in learning and in judging alike.

Defined cases: a null text, or one without a letter, is "und" with score 0; a null id is judged and never learned from;
without labelled documents everything is "und"; a very long text is judged whole, some characters at a time; of
languages with equal shares the first by code point is given; repeated rows are judged each for itself; an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 3, 1
FIT_ROWS = 400
#: With more languages than this, rows of each language, texts judged at a time and the like shrink in proportion.
WIDE = 64
STRETCHES, STRETCH = 4, 16
WINDOW, LONG = 64, 64
#: Hashed features, and words of the lexicon.
FEATURES, LEXICON = 1 << 16, 5000
EPOCHS, BATCH, RATE, DECAY = 5, 256, 0.5, 1e-6
#: Words whose scores a worker remembers, and characters judged at a time.
CACHE, TAKE = 400_000, 1_000_000
UNKNOWN = "und"
_FIRST, _LAST = "\x02", "\x03"


_LONG_RUN = re.compile(rf"\S{{{LONG + 1}}}")


def words(text: str | None) -> list[str]:
    """Runs between white space, in lower case, those of more than LONG characters in parts."""
    runs = (text or "").lower().split()
    if text and _LONG_RUN.search(text):
        runs = [r[i : i + LONG] for r in runs for i in range(0, len(r), LONG)]
    return runs


@functools.lru_cache(maxsize=1 << 16)
def letters(run: str) -> str:
    """The letters of a run, or an empty string."""
    return run if run.isalpha() else "".join(c for c in run if c.isalpha())


def shrunk(bound: int, langs: int) -> int:
    """A bound on rows, words or characters that holds up to WIDE languages, for so many."""
    return bound if langs <= WIDE else max(1, bound * WIDE // langs)


class Features:
    """Numbers of the features of words: hashed n-grams and affixes, and the lexicon behind them."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: FEATURES + i for i, w in enumerate(lexicon)}
        self.size = FEATURES + len(lexicon)

    def of(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the words, one word after another, and where each word's start."""
        marked = "".join(f"{_FIRST}{w}{_LAST}" for w in found)
        codes = np.frombuffer(marked.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
        n = len(codes)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 2
        ends = np.cumsum(sizes)
        at = np.arange(n)
        left = np.repeat(ends, sizes) - at  # characters from here to the word's end, this one included
        from_start = at - np.repeat(ends - sizes, sizes)
        step = lambda k: codes[np.minimum(at + k, n - 1)]

        def hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
            h = np.full(n, kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for x in parts:
                h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            return (h % np.uint64(FEATURES)).astype(np.int64)

        with np.errstate(over="ignore"):
            kinds = [
                (hashed(2, codes, step(1)), left >= 2),
                (hashed(3, codes, step(1), step(2)), left >= 3),
                (hashed(4, codes, step(1), step(2), step(3)), (left >= 4) & ((from_start == 0) | (left == 4))),
            ]
        lexicon = np.array([self.lexicon.get(w, -1) for w in found], dtype=np.int64)
        of = np.repeat(np.arange(len(found)), sizes)
        number = np.concatenate([h[ok] for h, ok in kinds] + [lexicon[lexicon >= 0]])
        owner = np.concatenate([of[ok] for _, ok in kinds] + [np.flatnonzero(lexicon >= 0)])
        order = np.argsort(owner, kind="stable")
        return number[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(found)))])[:-1]


class Model:
    """Languages, feature weights (features x languages), transitions and starts."""

    def __init__(self, langs: list[str], features: Features, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.langs, self.features, self.weights, self.moves, self.start = langs, features, weights, moves, start

    def emissions(self, found: list[str]) -> np.ndarray:
        """Scores of every word in every language."""
        number, starts = self.features.of(found)
        return np.add.reduceat(self.weights[number], starts, axis=0)


def forward_backward(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Shares of the labels at each place of chains (chains x places x labels), whose real places come first; with pairs, also the expected moves and the log of the chains' sums."""
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    step, first = np.exp(moves), np.exp(start)
    n, length, k = scores.shape
    a, b, scale = np.empty_like(e), np.empty_like(e), np.ones((n, length), dtype=e.dtype)
    for t in range(length):
        x = e[:, 0] * first if t == 0 else (a[:, t - 1] @ step) * e[:, t]
        s = x.sum(axis=1)
        a[:, t] = x / s[:, None]
        scale[:, t] = s
        if t:
            rest = ~real[:, t]
            a[rest, t] = a[rest, t - 1]
            scale[rest, t] = 1
    b[:, length - 1] = 1
    for t in range(length - 2, -1, -1):
        x = (b[:, t + 1] * e[:, t + 1]) @ step.T
        x /= scale[:, t + 1, None]
        b[:, t] = np.where(real[:, t + 1, None], x, 1)
    share = a * b
    share /= share.sum(axis=2, keepdims=True)
    if not pairs:
        return share
    moved = np.zeros((k, k))
    for t in range(1, length):
        r = real[:, t]
        z = (a[r, t - 1][:, :, None] * step[None] * (e[r, t] * b[r, t])[:, None, :]) / scale[r, t][:, None, None]
        moved += z.sum(axis=0)
    return share, moved, (np.log(scale) * real).sum() + (top[:, :, 0] * real).sum()


def train(stretches: list[tuple[str, list[str]]], seed: int = 0) -> Model | None:
    """A model from stretches of words of one language each."""
    langs = sorted({lang for lang, w in stretches if w})
    if not langs:
        return None
    counts = Counter(w for _, ws in stretches for w in set(ws))
    features = Features([w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c >= 3])
    k, rng = len(langs), np.random.default_rng(seed)
    label = {x: i for i, x in enumerate(langs)}
    by: list[list[list[str]]] = [[] for _ in langs]
    for lang, ws in stretches:
        if ws:
            by[label[lang]].append(ws)
    most = max(map(len, by))
    chains: list[list[tuple[int, list[str]]]] = []
    for y, own in enumerate(by):
        for i in range(most):  # the rarer languages' stretches repeat
            chain = [(y, own[i % len(own)])]
            if k > 1 and i % 2:
                z = int(rng.integers(k - 1))
                z += z >= y
                chain.append((z, by[z][int(rng.integers(len(by[z])))]))
            chains.append(chain)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for _, ws in c for w in ws))}
    number, starts = features.of(list(vocabulary))
    ends = np.append(starts[1:], len(number))
    length = 2 * STRETCH
    place = np.zeros((len(chains), length), dtype=np.int64)
    truth, real = np.zeros((len(chains), length), dtype=np.int64), np.zeros((len(chains), length), dtype=bool)
    for i, chain in enumerate(chains):
        flat = [(vocabulary[w], y) for y, ws in chain for w in ws][:length]
        place[i, : len(flat)], truth[i, : len(flat)], real[i, : len(flat)] = [x for x, _ in flat], [y for _, y in flat], True
    weights, moves, start = np.zeros((features.size, k), dtype=np.float64 if k <= WIDE else np.float32), np.zeros((k, k)), np.zeros(k)
    batch = shrunk(BATCH, k)
    past = [np.full_like(x, 1e-6) for x in (weights, moves, start)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            r, y = real[pick], truth[pick]
            used, at = np.unique(place[pick], return_inverse=True)
            at = at.reshape(len(pick), length)
            sizes = ends[used] - starts[used]
            flat = number[np.repeat(starts[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores = np.add.reduceat(weights[flat], firsts, axis=0)[at]
            share, moved, _ = forward_backward(scores, r, moves, start, pairs=True)
            # Gradient of the log-likelihood: what the labels have less what the model expects.
            gap = (np.eye(k)[y] - share) * r[:, :, None]
            word_gap = np.stack([np.bincount(at.ravel(), gap[:, :, j].ravel(), minlength=len(used)) for j in range(k)], axis=1)
            spread = np.repeat(word_gap, sizes, axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            g_weights = np.stack([np.bincount(where, spread[:, j], minlength=len(touched)) for j in range(k)], axis=1) / len(pick)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1][r[:, 1:]], y[:, 1:][r[:, 1:]]), 1)
            g_moves = (seen - moved) / len(pick)
            g_start = gap[:, 0].sum(axis=0) / len(pick)
            past[0][touched] += g_weights**2
            weights[touched] += RATE * (g_weights - DECAY * weights[touched]) / np.sqrt(past[0][touched])
            past[1] += g_moves**2
            moves += RATE * g_moves / np.sqrt(past[1])
            past[2] += g_start**2
            start += RATE * g_start / np.sqrt(past[2])
    return Model(langs, features, weights.astype(np.float32), moves, start)


class Judge:
    """Mean shares of the languages in texts, and the words' labels, by a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((1024, len(model.langs)), dtype=np.float32)
        self.cache, self.take = (shrunk(x, len(model.langs)) for x in (CACHE, TAKE))

    def _learn(self, runs: set[str]) -> None:
        fresh = list(runs)
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            plain = [r if r.isalpha() else letters(r) for r in part]
            real = [i for i, w in enumerate(plain) if w]
            self.known.update((part[i], -1) for i, w in enumerate(plain) if not w)
            if real:
                n = self.count
                while n + len(real) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n : n + len(real)] = self.model.emissions([plain[i] for i in real])
                self.known.update((part[i], n + j) for j, i in enumerate(real))
                self.count += len(real)

    count = 0

    def shares(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Mean shares of each text, or None for one without a letter."""
        return (mean for mean, _ in self.judged(texts))

    def judged(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray | None, list[str]]]:
        """Of each text the mean shares, or None for one without a letter, and the runs of words of one language.

        A run is "language:first:end", by numbers of the text's words(), of which the end is the first behind the run.
        """
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= self.take):
                size += len(texts[hi] or "")
                hi += 1
            yield from self._judged(texts[lo:hi])
            lo = hi

    def _judged(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, list[str]]]:
        if self.count > self.cache:
            self.known, self.count = {}, 0
        get, found, gaps = self.known.get, [], set()
        for text in texts:
            runs = words(text)
            at = list(map(get, runs))
            if None in at:
                gaps.update(r for r, x in zip(runs, at, strict=True) if x is None)
                found.append((at, runs))
            else:
                found.append((at, None))
        self._learn(gaps)
        get = self.known.__getitem__
        rows = [np.array([get(r) if x is None else x for r, x in zip(runs, at, strict=True)] if runs is not None else at, dtype=np.int64) for at, runs in found]
        # A word without a letter has no label of its own; within a run it belongs to it.
        numbers = [np.flatnonzero(x >= 0) for x in rows]
        rows = [x[at] for x, at in zip(rows, numbers, strict=True)]
        sizes = np.array([len(x) for x in rows], dtype=np.int64)
        out: list[tuple[np.ndarray | None, list[str]]] = [(None, [])] * len(texts)
        if not sizes.sum():
            return out
        flat = np.concatenate(rows)
        chains = -(-sizes // WINDOW)
        total = int(chains.sum())
        # Word j of a text is at place j % WINDOW of the text's chain j // WINDOW.
        first_chain = np.concatenate([[0], np.cumsum(chains)[:-1]])
        j = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        slot = (np.repeat(first_chain, sizes) + j // WINDOW) * WINDOW + j % WINDOW
        k = self.table.shape[1]
        scores, real = np.zeros((total * WINDOW, k), dtype=np.float32), np.zeros(total * WINDOW, dtype=bool)
        scores[slot], real[slot] = self.table[flat], True
        share = forward_backward(scores.reshape(total, WINDOW, k), real.reshape(total, WINDOW), self.model.moves.astype(np.float32), self.model.start.astype(np.float32))
        share = share.reshape(-1, k)[slot]
        some = np.flatnonzero(sizes)
        firsts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        sums = np.add.reduceat(share.astype(np.float64), firsts, axis=0)
        labels = share.argmax(axis=1)
        new = np.ones(len(labels), dtype=bool)
        new[1:] = labels[1:] != labels[:-1]
        new[firsts] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(labels))
        at = np.concatenate(numbers)
        runs = [f"{self.model.langs[y]}:{a}:{b}" for y, a, b in zip(labels[starts].tolist(), at[starts].tolist(), (at[ends - 1] + 1).tolist(), strict=True)]
        cuts = [*np.searchsorted(starts, firsts).tolist(), len(runs)]
        for j, (i, s) in enumerate(zip(some, sums, strict=True)):
            out[i] = (s / sizes[i], runs[cuts[j] : cuts[j + 1]])
        return out


def stretches(rows: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> list[tuple[str, list[str]]]:
    """The bounded sample of rows (doc_id, text, lang)."""
    fit = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.id_fold(F.col("doc_id"), folds) != held_out))
    found = fit.groupBy("lang").count().collect()
    if not found:
        return []
    most = shrunk(FIT_ROWS, len(found))
    # A row stays if its hash is among the smallest of its language: half as many again as needed are expected, and the smallest are kept.
    rates = rows.sparkSession.createDataFrame([(r.lang, min(1.0, (1.5 * most + 30) / r["count"])) for r in found], "lang string, rate double")
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(2**53))
    picked = fit.withColumn("u", u).join(F.broadcast(rates), "lang").where(F.col("u") < F.col("rate"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches):
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, text, lang, u in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ws = [w for w in map(letters, words(text)) if w]
                for i in range(min(STRETCHES, -(-len(ws) // STRETCH))):
                    at = zlib.crc32(f"{doc_id}/{i}".encode()) % max(1, len(ws) - STRETCH + 1)
                    for o, x in zip(out, (lang, u, ws[at : at + STRETCH]), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.string()))], names=["lang", "u", "words"])

    got = picked.select("doc_id", "text", "lang", "u").mapInArrow(cut, "lang string, u double, words array<string>").collect()
    out, documents = [], {}
    for r in sorted(got, key=lambda r: (r.lang, r.u, r.words)):
        seen = documents.setdefault(r.lang, set())
        if r.u in seen or len(seen) < most:
            seen.add(r.u)
            out.append((r.lang, r.words))
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(common.id_fold(key, FOLDS) == HELD_OUT, F.lit(False))


_judges: dict[str, Judge] = {}


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, spans of rows (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("spans"))
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        # A worker that runs several tasks keeps what it has learned about words.
        if tag not in _judges:
            _judges.clear()
            _judges[tag] = Judge(shared.value)
        judge = _judges[tag]

        def f(x: dict) -> dict:
            out: dict = {"doc_id": x["doc_id"], "lang_pred": [], "score": [], "spans": []}
            for s, runs in judge.judged(x["text"]):
                best = None if s is None else int(np.argmax(s))
                out["lang_pred"].append(UNKNOWN if s is None else judge.model.langs[best])
                out["score"].append(0.0 if s is None else min(1.0, float(s[best])))
                out["spans"].append(runs)
            return out

        return f

    return common.map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, spans array<string>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every document, by a model learned from the others' languages."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = predict(rows.select("doc_id", "text"), train(stretches(rows)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_langid": op7_langid}
ORACLES: dict[str, str] = {}
