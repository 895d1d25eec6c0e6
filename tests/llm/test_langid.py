import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keytide.llm import langid

from . import cases

SF = "/root/testdata/sf0.01"
ENDS = {"xx": ("ska", "nen", "oi"), "yy": ("lth", "ing", "ewe"), "zz": ("ção", "ez", "qui")}


def sentence(r, lang, n):
    return " ".join(r.choice("bdfgklmnprst") + r.choice("aeiou") + r.choice(ENDS[lang]) for _ in range(n))


def corpus(n, seed=0):
    r = random.Random(seed)
    return [(i, sentence(r, lang, r.randint(8, 60)), lang, "s", 1) for i in range(n) for lang in [r.choice(list(ENDS))]]


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(1)
    sizes, k, length = (4, 2, 1), 3, 4
    scores, moves, start = r.normal(size=(3, length, k)), r.normal(size=(k, k)), r.normal(size=k)
    real = np.array([[t < s for t in range(length)] for s in sizes])
    share, moved, log_sum = langid.forward_backward(scores, real, moves, start, pairs=True)
    want_moves, want_log = np.zeros((k, k)), 0.0
    for c, size in enumerate(sizes):
        paths = list(itertools.product(range(k), repeat=size))
        value = np.exp([start[p[0]] + sum(scores[c, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        want_log += np.log(value.sum())
        value /= value.sum()
        for t in range(size):
            assert np.allclose(share[c, t], [value[[p[t] == y for p in paths]].sum() for y in range(k)])
        for p, v in zip(paths, value, strict=True):
            for a, b in itertools.pairwise(p):
                want_moves[a, b] += v
    assert np.allclose(moved, want_moves) and np.isclose(log_sum, want_log)


def test_features_of_a_word_stand_alone():
    features = langid.Features(["abc"])
    together, starts = features.of(["abc", "x", "éab"])
    ends = [*starts[1:], len(together)]
    for i, w in enumerate(["abc", "x", "éab"]):
        alone, _ = features.of([w])
        assert sorted(alone) == sorted(together[starts[i] : ends[i]])
    assert langid.FEATURES in features.of(["abc"])[0]


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    return langid.train([(lang, sentence(r, lang, langid.STRETCH).split()) for lang in ENDS for _ in range(150)])


def test_code_switched_words_are_labelled(model):
    r = random.Random(9)
    judge = langid.Judge(model)
    for a, b in itertools.permutations(ENDS, 2):
        (mean,) = judge.shares([sentence(r, a, 30) + " " + sentence(r, b, 10)])
        assert abs(mean[model.langs.index(a)] - 0.75) < 0.08 and abs(mean[model.langs.index(b)] - 0.25) < 0.08


def test_spans_label_every_word(spark, model):
    r = random.Random(9)
    text = sentence(r, "xx", 20) + " 12 , " + sentence(r, "yy", 70) + " ! " + sentence(r, "zz", 20)
    want = ["xx"] * 20 + [None] * 2 + ["yy"] * 70 + [None] + ["zz"] * 20
    rows = langid.predict(spark.createDataFrame([(1, text), (2, "12 !"), (3, None), (4, "9 " + sentence(r, "yy", 3))], "doc_id long, text string"), model).collect()
    spans = {x.doc_id: [(lang, int(a), int(b)) for lang, a, b in (s.rsplit(":", 2) for s in x.spans)] for x in rows}
    got = [next((lang for lang, a, b in spans[1] if a <= i < b), None) for i in range(len(want))]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= len(want) - 4
    assert all(x[2] <= y[1] for x, y in itertools.pairwise(spans[1]))
    assert spans[2] == spans[3] == [] and spans[4] == [("yy", 1, 4)]


def test_long_runs_are_cut_alike():
    assert langid.words("ab " + "x" * 150 + " c") == ["ab", "x" * 64, "x" * 64, "x" * 22, "c"] and langid.words(None) == []
    assert langid.words("X" * 64) == ["x" * 64]


def test_learning_follows_the_gradient():
    """A step's gradient of the log-likelihood against differences, for one chain of two languages."""
    r = np.random.default_rng(2)
    scores, moves, start = r.normal(size=(1, 4, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    real, truth = np.ones((1, 4), dtype=bool), np.array([0, 0, 1, 1])

    def likelihood(scores, moves):
        _, _, log_sum = langid.forward_backward(scores, real, moves, start, pairs=True)
        return start[truth[0]] + sum(scores[0, t, y] for t, y in enumerate(truth)) + sum(moves[a, b] for a, b in itertools.pairwise(truth)) - log_sum

    share, moved, _ = langid.forward_backward(scores, real, moves, start, pairs=True)
    for t, y in itertools.product(range(4), range(2)):
        step = np.zeros_like(scores)
        step[0, t, y] = 1e-5
        slope = (likelihood(scores + step, moves) - likelihood(scores - step, moves)) / 2e-5
        assert np.isclose(slope, (truth[t] == y) - share[0, t, y], atol=1e-6)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:-1], truth[1:]), 1)
    for a, b in itertools.product(range(2), range(2)):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert np.isclose((likelihood(scores, moves + step) - likelihood(scores, moves - step)) / 2e-5, (seen - moved)[a, b], atol=1e-6)


def test_a_text_is_judged_alike_in_any_company(model, monkeypatch):
    r = random.Random(2)
    texts = [None, "", "12 !", *(sentence(r, lang, n) for lang in ENDS for n in (1, 63, 64, 65, 300))]
    together = list(langid.Judge(model).shares(texts))
    monkeypatch.setattr(langid, "TAKE", 100)
    monkeypatch.setattr(langid, "CACHE", 20)
    judge = langid.Judge(model)
    for t, a, b in zip(texts, together, judge.shares(texts), strict=True):
        (alone,) = langid.Judge(model).shares([t])
        if a is None:
            assert b is None and alone is None
        else:
            assert np.allclose(a, b, atol=1e-5) and np.allclose(a, alone, atol=1e-5)


def test_held_out_languages_and_other_columns_are_not_inputs(spark):
    rows = corpus(200)
    other = [(i, t, "qq" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, str(i), 5) for i, t, lang, *_ in rows]
    assert cases.rows_of(langid.identify(cases.frame(spark, rows))) == cases.rows_of(langid.identify(cases.frame(spark, other)))


def test_every_language_is_learned(spark):
    """More languages than the bounds are made for, the rarest with a few documents."""
    r = random.Random(6)
    names = [a + b for a, b in itertools.product("abcdefghij", "klmnopqr")]
    assert len(names) > langid.WIDE
    rows = [(i, " ".join(r.choice("bdfgmnpst") + 2 * names[k] for _ in range(30)), names[k], "s", 1) for i in range(1200) for k in [i % len(names) if i < 800 else i % 40]]
    assert {lang for lang, _ in langid.stretches(cases.frame(spark, rows).select("doc_id", "text", "lang"))} == set(names)
    got = {x.doc_id: x.lang_pred for x in langid.identify(cases.frame(spark, rows)).where("held_out").collect()}
    right = [got[i] == lang for i, _, lang, *_ in rows if i in got]
    assert {lang for i, _, lang, *_ in rows if i in got and got[i] == lang} > set(names[40:60]) and sum(right) > 0.95 * len(right)


def test_awkward_rows(spark, tmp_path):
    rows = [(i + 1000, *x) for i, *x in corpus(200)] + cases.awkward()
    docs = cases.with_clashes(cases.frame(spark, rows))
    got = langid.op7_langid(spark, cases.save(docs, tmp_path, "documents")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in rows)
    texts = {}
    for doc_id, t, *_ in rows:
        texts.setdefault(doc_id, []).append(t)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if len(texts[r.doc_id]) == 1:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id][0] or "")))
        assert r.lang_pred in {"und", "xx", "yy", "zz"}
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op7_langid(spark, SF).where("held_out and lang_pred <> 'und'").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang_pred == r.lang for r in rows) / len(rows)
    print("held out:", len(rows), "right", right)
    assert len(rows) > 200 and right > 0.95
