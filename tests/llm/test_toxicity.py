import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from keytide.llm import toxicity

from . import cases

SF = "/root/testdata/sf0.1"
FOUL = ("grommel", "skavent", "blorfin")


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        (None, "  "),
        ("Plain, words\nhere!", " plain words here "),
        ("gr0mm3l", " gromme1 "),
        ("grоmmеl", " grommel "),
        ("ｇｒｏｍ", " grom "),
        ("gro​m­m", " gromm "),
        ("\u0392LORFIN \u0397ATE \u039cOB", " blorfin hate mob "),
        ("gr\u00e9mmel \u010cafe\u0301", " gremmel cafe "),
        ("in 2024 or 10,000", " in 2024 or 10 000 "),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_hits_are_word_beginnings_outside_exceptions():
    lexicon = toxicity.Lexicon({"skav": 1.0, "skavent": 2.0, "blorf": 1.0}, ("blorf fish",))
    hits = lambda t: dict(lexicon.hits(toxicity.fold(t)))
    assert hits("skaventing a SKAV, unskav") == {"skavent": 1, "skav": 1}
    assert hits("blorf fish and blorf") == {"blorf": 1}
    assert hits("5kav") == {"skav": 1}
    assert hits("b1orf") == {"blorf": 1}


def test_the_sieve_loses_no_hit():
    lexicon = toxicity.Lexicon({w: 1.0 for w in ("skav", "blorf", "grom")})
    r = random.Random(0)
    for _ in range(2000):
        t = "".join(r.choice(["skav", "blorf", "b1orf", "gr0m", "x", " ", "_", "-", "1", "é", "о"]) for _ in range(r.randint(1, 6)))
        assert bool(lexicon.hits(toxicity.fold(t))) <= lexicon.may_hit(toxicity.fold_letters(t))


def slow_score(lexicon, text):
    """Every word against every entry, phrases by looking at the next word."""
    one = str.maketrans("il", "11")
    words = toxicity.fold(text).split()
    weight = 0.0
    for i, w in enumerate(words):
        fits = [e for e in lexicon.weights if w.startswith(e) or w.startswith(e.translate(one))]
        spared = any(words[i : i + 2] == p.split() or (i and words[i - 1 : i + 1] == p.split()) for p in lexicon.exceptions)
        if fits and not spared:
            weight += lexicon.weights[max(fits, key=len)]
    a, b = (math.log1p(weight), math.log1p(100 * weight / max(1, len(words)))) if weight else (0.0, 0.0)
    return 1 / (1 + math.exp(-(lexicon.model[0] + lexicon.model[1] * a + lexicon.model[2] * b)))


def test_scores_equal_a_slow_search():
    lexicon = toxicity.Lexicon({"skav": 1.5, "skavent": 2.0, "blorf": 0.7, "grommelfritz": 3.0, "lil": 1.1}, ("blorf fish", "skavent b"), (-2.0, 0.8, 0.4))
    r, hit = random.Random(4), 0
    for _ in range(3000):
        parts = ["skav", "5kavent", "Blorf", "bl\u043erf", "fish", "b", "x", "grommelfritz", "gromm\u00e9lfritzing", "l1l", "lil", "unskav", "12", "!", "_", "skavent"]
        text = "".join(r.choice(parts) + r.choice((" ", " ", "", "-", "_")) for _ in range(r.randint(0, 9)))
        assert lexicon.score(text) == pytest.approx(slow_score(lexicon, text)), text
        hit += lexicon.score(text) > lexicon.score("")
    assert hit > 1000


def test_long_entries_are_learned(spark):
    """Only the twelfth letter tells the foul word from a clean one."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = cases.prose(r, r.randint(20, 60)).split()
        words.insert(3, "grommelfritza" if i % 3 == 0 else "grommelfritzo")
        rows.append((i, " ".join(words), "xx", "a", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    lexicon = toxicity.learn(cases.frame(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    assert lexicon.score("a grommelfritza") > 0.5 > lexicon.score("a grommelfritzo")


@pytest.mark.parametrize("unit", ["x", "x1", "1", "$_", "о1", "grom "])
def test_long_texts_take_linear_time(unit):
    lexicon = toxicity.Lexicon({"grom": 1.0}, ("grom fish",))
    began = time.perf_counter()
    assert 0 <= lexicon.score(unit * 400_000) <= 1
    assert time.perf_counter() - began < 10


def corpus(n, seed=0):
    """Made-up prose; toxic documents hold one of three stems, some of them disguised."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = cases.prose(r, r.randint(20, 120)).split()
        if toxic := i % 4 == 0:
            w = r.choice(FOUL) + r.choice(("", "s", "ing"))
            w = r.choice((w, w.upper(), w.replace("o", "0"), w.replace("e", "3").replace("o", "о")))
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words), "xx", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_learned_stems_find_unlabelled_toxic_documents(spark):
    rows, labels = corpus(1200)
    got = toxicity.score(cases.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def test_scores_mean_the_same_when_labels_outgrow_the_sample(spark, monkeypatch):
    """One document in nine is toxic, and one of four of those says nothing foul."""
    rows, _ = corpus(1800)
    labels = [(i, 1, int(i % 8 == 0 or i % 48 == 2)) for i, *_ in rows]
    rows = [x for x in rows if x[0] % 4 or x[0] % 8 == 0]
    docs, truth = cases.frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] % 4 or x[0] % 8 == 0], LABELS)
    texts = ["nothing of the kind", "a grommel " + "and more " * 20]
    whole = [toxicity.learn(docs, truth).score(t) for t in texts]
    monkeypatch.setattr(toxicity, "FIT_ROWS", 120)
    bounded = [toxicity.learn(docs, truth).score(t) for t in texts]
    assert whole[0] < 0.1 and bounded[0] == pytest.approx(whole[0], abs=0.05) and bounded[1] == pytest.approx(whole[1], abs=0.1)


def test_held_out_labels_and_other_columns_are_not_inputs(spark):
    rows, labels = corpus(400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs = cases.frame(spark, rows)
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.col("doc_id").cast("string")})
    assert cases.rows_of(toxicity.score(docs, spark.createDataFrame(labels, LABELS))) == cases.rows_of(toxicity.score(changed, spark.createDataFrame(flipped, LABELS)))


def test_awkward_rows(spark, tmp_path):
    rows, labels = corpus(300)
    rows = [(i + 1000, *x) for i, *x in rows] + cases.awkward()
    labels = [(i + 1000, q, t) for i, q, t in labels] + [(None, None, 1), (1000, 1, None), (1001, 1, 1), (1001, 1, 0), (9, 1, 7), (999_999, 1, 1)]
    docs = cases.with_clashes(cases.frame(spark, rows))
    truth = cases.with_clashes(cases.frame(spark, labels, LABELS))
    cases.save(truth, tmp_path, "labels")
    got = toxicity.op2_toxicity(spark, cases.save(docs, tmp_path, "documents")).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(x[0]) for x in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (100, 101, 102)}) == 1
    kept = toxicity.filter(docs, truth)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), truth).count() == 0
    assert {r.score for r in toxicity.score(docs, truth.limit(0)).collect()} == {0.0}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    print("held out:", len(toxic), "toxic found", sum(toxic), "; clean", len(clean), "flagged", sum(clean))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)
