"""Toxicity: a weighted lexicon of word beginnings, matched by Aho-Corasick in folded text.

Folding replaces compatibility forms, takes accents off, replaces look-alike letters of other scripts (capitals by what
capitals look like), lower-cases, reads digits and signs inside words as the letters they stand for, and leaves one space
between words, so that an entry " stem" matches a word's start. An exception phrase, an entry and the word that makes it harmless, takes back the entry's hit inside it.

The lexicon and its weights are learned from labelled documents. The sample is bounded: of either label, the FIT_ROWS
documents with the smallest hashes of their ids. Whole words, and word beginnings of up to LONGEST letters, are counted by
documents; all that are telling become candidates, candidates are matched in the sample, and entries are chosen one by
one for the toxic documents that they alone explain. The score is a logistic function of the sum of weights of a document's hits and of that sum normalised by
its length in words, fitted on the same sample with either label weighted to its share of all labels that may be
learned from, so that a score means the same however many there are.

Defined cases: a null text is an empty one, and both get the score of a text without hits; a very long text is folded and
matched whole, in linear time; of entries or phrases that say the same the one nearer to a usual length, then the first
by code point, is taken; a null id is scored and is
never learned from; repeated rows are scored each for itself; a document with several labels is learned from once with
the largest; without labels of both kinds every score is 0; an empty table gives an empty result; further columns play
no part (filter() carries them along).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled documents of either kind to learn from.
FIT_ROWS = 4000
#: Lengths of word beginnings; a whole word may be longer. A clean phrase is an exception from so many documents on.
SHORTEST, LONGEST, SPARED = 4, 40, 3
#: An entry explains at least so many toxic documents alone, and is so many times likelier in toxic documents.
LEAST_NEW, LEAST_RATIO = 3, 8.0
#: The least new documents as a share of the toxic ones, of which there are more in a larger sample.
LEAST_SHARE = 0.003
#: An entry is taken on its own if the number of toxic documents times the log of the ratio, and their share, are as high as this.
SURE, SURE_SHARE = 25.0, 0.02
#: A stem's usual length.
STEM = 5

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("аеіјорсухѕһԁԛԝвкмнтɡıαεικνορτυχ", "aeijopcyxshdqwbkmhtgiaeikvoptux", strict=True))
CAPITALS = dict(zip("АВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abesijkmhopctyxabezhikmnoptyx", strict=True))
DIGITS = dict(zip("034578@$", "oeastbas", strict=True))
#: Invisible characters, which folding drops.
_FOLD = str.maketrans(LOOKALIKES) | dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_CAPITAL = str.maketrans(CAPITALS)
_BIG = re.compile("[" + "".join(CAPITALS) + "]")
#: Accents of decomposed letters; marks of scripts that write vowels as marks stay.
_ACCENTS = re.compile("[\u0300-\u036f]+")
#: In a word with digits 1, i and l are one letter, as 1 stands for either.
_ONE = str.maketrans("il", "11")
_DIGIT = str.maketrans(DIGITS) | _ONE
_STRANGE = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
#: A run between white space that has a digit or sign that may stand for a letter; linear, as it starts only where a run does.
_MIXED = re.compile(r"(?<!\S)[^\s034578@$1]*+[034578@$1]\S*")
_PART = re.compile(r"[\w@$]+")
_OTHER = re.compile(r"[\W_]+")


def _read_digits(run: re.Match) -> str:
    return _PART.sub(lambda m: m.group().translate(_DIGIT) if any(map(str.isalpha, m.group())) and not m.group().isalpha() else m.group(), run.group())


def fold_letters(text: str | None) -> str:
    """The text in lower case with look-alike letters and letter-like digits replaced; whatever separates words stays."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFKD", text)))
        if _BIG.search(text):
            text = text.translate(_CAPITAL)
        text = text.lower()
        if _STRANGE.search(text):
            text = text.translate(_FOLD)
    else:
        text = text.lower()
    return _MIXED.sub(_read_digits, text)


def spaced(letters: str) -> str:
    """Words of a folded text, a space before each and one at the end."""
    return f" {_OTHER.sub(' ', letters).strip()} "


def fold(text: str | None) -> str:
    return spaced(fold_letters(text))


class Lexicon:
    """Entries " stem" with weights, and exception phrases; matches by one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), model: tuple[float, float, float] = (0.0, 1.0, 1.0)):
        self.weights, self.exceptions, self.model = weights, exceptions, model
        self._built = self._sieve = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None, "_sieve": None}

    def sieve(self):
        """Entries without regard to where words start, for letters that aren't spaced yet."""
        if self._sieve is None:
            self._sieve = ahocorasick.Automaton()
            for word in self.weights:
                for w in (word, word.translate(_ONE)):
                    self._sieve.add_word(w, len(w))
            if len(self._sieve):
                self._sieve.make_automaton()
        return self._sieve

    def may_hit(self, letters: str) -> bool:
        """Whether an entry stands where a word starts: most texts need no more than this."""
        a = self.sieve()
        if len(a):
            for end, size in a.iter(letters):
                before = end - size
                if before < 0 or letters[before] == "_" or not letters[before].isalnum():
                    return True
        return False

    def automaton(self):
        if self._built is None:
            self._built = ahocorasick.Automaton()
            for word in self.weights:
                self._built.add_word(f" {word.translate(_ONE)}", (len(word), word))
            for word in self.weights:
                self._built.add_word(f" {word}", (len(word), word))
            for phrase in self.exceptions:
                self._built.add_word(f" {phrase} ", (len(phrase), None))
            if len(self._built):
                self._built.make_automaton()
        return self._built

    def hits(self, folded: str) -> Counter:
        """Number of words that begin with each entry, outside exception phrases; of entries at one word the longest counts."""
        a = self.automaton()
        if not len(a):
            return Counter()
        at: dict[int, str] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, word) in a.iter(folded):
            if word is None:
                spared.append((end - size - 1, end))
            elif len(at.get(start := end - size, "")) < size:
                at[start] = word
        if spared:
            at = {s: w for s, w in at.items() if not any(lo <= s < hi for lo, hi in spared)}
        return Counter(at.values())

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of the hits, damped, and its share of the text's words."""
        letters = fold_letters(text)
        if not self.may_hit(letters):
            return 0.0, 0.0
        folded = spaced(letters)
        weight = sum(self.weights[w] * n for w, n in self.hits(folded).items())
        words = max(1, folded.count(" ") - 1)
        return math.log1p(weight), math.log1p(100 * weight / words)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.model[0] + self.model[1] * a + self.model[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def beginnings(folded: str) -> set[str]:
    """Distinct beginnings of the words, and the words themselves."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= SHORTEST and not word.isdigit():
            out.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
            out.add(word)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, stands: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is constant, and a row counts as often as it stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * stands) + ridge * len(y) * w
        hess = (x * (p * (1 - p) * stands)[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose(positives: list[list[str]], negatives: list[list[str]]) -> dict[str, float]:
    """Entries and weights from the candidates that each document contains.

    First come, by what they say, all that are telling on their own (SURE); then, one by one, the candidate that says
    most about the toxic documents that no entry explains yet.
    """
    pos, neg = Counter(w for d in positives for w in d), Counter(w for d in negatives for w in d)
    n1, n0 = max(1, len(positives)), max(1, len(negatives))
    strength = {w: math.log((c + 0.5) / (n1 + 1)) - math.log((neg[w] + 0.5) / (n0 + 1)) for w, c in pos.items()}
    where: dict[str, set[int]] = {}
    for i, d in enumerate(positives):
        for w in d:
            where.setdefault(w, set()).add(i)
    left, out = set(range(len(positives))), {}
    # Of two that say the same, the one nearer to a usual stem's length.
    order = lambda w: (-abs(len(w) - STEM), w)

    def stem(word: str, gain) -> str:
        """A shorter beginning that covers more and is as clean takes the place of a longer one."""
        for n in range(SHORTEST, len(word)):
            more = gain(s := word[:n]) - gain(word)
            if s in strength and more > 0 and (neg[s] - neg[word]) / n0 <= 0.05 * more / n1:
                return s
        return word

    def take(word: str) -> None:
        out[word] = max(0.1, strength[word])
        left.difference_update(where[word])

    sure = [w for w in pos if pos[w] * strength[w] >= SURE and pos[w] >= SURE_SHARE * n1 and strength[w] >= math.log(4 * LEAST_RATIO)]
    for w in sorted(sure, key=lambda w: (pos[w] * strength[w], *order(w)), reverse=True):
        s = stem(w, lambda x: pos[x])
        if not any(s.startswith(o) or o.startswith(s) for o in out):
            take(s)
    least = max(LEAST_NEW, LEAST_SHARE * n1)
    gains = {w: n for w in pos if strength[w] >= math.log(LEAST_RATIO) and (n := len(where[w] & left)) >= least}
    while gains:
        best = stem(max(gains, key=lambda w: (gains[w] * strength[w], *order(w))), lambda x: gains.get(x, 0))
        # Only candidates of the documents that are now explained lose some.
        told = where[best] & left
        take(best)
        gains.pop(best, None)
        for w, n in Counter(w for i in told for w in positives[i] if w in gains).items():
            gains[w] -= n
            if gains[w] < least:
                del gains[w]
    return out


def signature(folded: str) -> int:
    """The smallest hash of the runs of four words: near copies share it."""
    words = folded.split()
    return min((zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))), default=0)


def _known(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id and y of all documents that may be learned from."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (common.id_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max(label_col).alias("y"))


def _sample(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """text and y of the bounded sample, from rows of the folds that may be learned from."""
    known = _known(labels, label_col)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(FIT_ROWS) for y in (0, 1)]
    # At most 2 * FIT_ROWS ids.
    ids = F.broadcast(picked[0].unionByName(picked[1]))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches):
            yield batch.append_column("copies", pa.array([signature(fold(t)) for t in batch.column(0).to_pylist()], pa.int64()))

    # Copies of one document would make all its words telling, so one of them is learned from.
    found = docs.select("doc_id", "text").join(ids, "doc_id").select("text", "y").mapInArrow(sign, "text string, y int, copies long")
    return found.groupBy("copies", "y").agg(F.min("text").alias("text")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Lexicon | None:
    """The lexicon, its exceptions and the score's model, from docs (doc_id, text) and labels (doc_id, label); None without labels of both kinds."""
    common.bound_batches(docs.sparkSession)
    sample = common.materialize(_sample(docs, labels, label_col))
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in common.cut(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(beginnings(fold(text)))
        words = list(found[0].keys() | found[1].keys())
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            yield pa.RecordBatch.from_pydict({"word": part, "neg": [found[0][w] for w in part], "pos": [found[1][w] for w in part]})

    sums = sample.mapInArrow(count, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 0.5) / (n[1] + 1)) - F.log((F.col("neg") + 0.5) / (n[0] + 1))
    told = sums.where((F.col("pos") >= LEAST_NEW) & (ratio >= math.log(LEAST_RATIO))).select("word")
    # As many as the words of the bounded sample that LEAST_NEW toxic documents share.
    wanted = frozenset(r.word for r in told.collect())

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches):
            found = [sorted(beginnings(fold(t)) & wanted) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["found", "y"])

    matched = sample.mapInArrow(match, "found array<string>, y int").collect()
    weights = choose([r.found for r in matched if r.y == 1], [r.found for r in matched if r.y == 0])
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(sample, lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.cut(batches):
            a, b = zip(*(lexicon.features(t) for t in batch.column(0).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column(1)], names=["a", "b", "y"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(measure, "a double, b double, y int").collect()])
    # Of either label the sample has FIT_ROWS at most, so its rows stand for all of their label.
    most = {r.y: r["count"] for r in _known(labels, label_col).groupBy("y").count().collect()}
    share = np.array([max(1.0, most[y] / FIT_ROWS) for y in (0, 1)])[rows[:, 2].astype(int)]
    stands = share * (len(rows) / share.sum())
    w = _logistic(np.column_stack([np.ones(len(rows)), rows[:, 0], rows[:, 1]]), rows[:, 2], stands)
    if w[1] < 0 or w[2] < 0:  # more hits never make a text less toxic
        w = np.insert(_logistic(np.column_stack([np.ones(len(rows)), rows[:, 0]]), rows[:, 2], stands), 2, 0.0)
    lexicon.model = tuple(map(float, w))
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Phrases of an entry's word and the next that occur in several clean documents of the sample and in no toxic one."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in common.cut(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text).split()
                starts = tuple(lexicon.weights)
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if starts and a.startswith(starts)}
                found.update((p, y) for p in pairs)
        keys = list(found)
        yield pa.RecordBatch.from_pydict({"phrase": pa.array([k[0] for k in keys], pa.string()), "y": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([found[k] for k in keys], pa.int64())})

    sums = sample.mapInArrow(phrases, "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"))
    return tuple(sorted(r.phrase for r in sums.where((F.col("clean") >= SPARED) & (F.col("bad") == 0)).collect()))


def score_udf(lexicon: Lexicon | None):
    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: 0.0 if lexicon is None else lexicon.score(t if isinstance(t, str) else None)).astype("float64")

    return score


def held_out(key: Column) -> Column:
    return F.coalesce(common.id_fold(key, FOLDS) == HELD_OUT, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lexicon = learn(rows, labels)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_udf(lexicon)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filter(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at or above the threshold."""
    lexicon = learn(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    return docs.where(score_udf(lexicon)(F.col(f"`{text_col}`")) < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
