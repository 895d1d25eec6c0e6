import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keytide.llm import mixing

from . import cases


def slow_targets(sizes: dict) -> dict:
    """Resharing step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice((0, 1, 10, 500, 10_000)) for s in ["a", "B", "é", "zz", "", None, "src10", "src9"][: r.randint(1, 8)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes)) or sum(sizes.values()) == 0


def test_word_count(spark):
    texts = [t for _, t, *_ in cases.awkward()] + ["a b c d", "\x0b\x0ca\x1cb "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", mixing.word_count(F.col("t")).alias("n")).collect():
        assert r.n == count(texts[r.i])


def check(spark, rows, got, near=None):
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += count(text)
    want = slow_targets(sizes)
    by_row = sorted(((r[0], count(r[1]), sizes[r[3]]) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == by_row
    taken, targets = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size, round(r.target, 6)] += r.taken
    merged = defaultdict(float)
    for s, n in sizes.items():
        merged[n, round(want[s], 6)] += want[s]
        targets[s] = want[s]
    for (n, t), total in merged.items():
        if n:
            key = min(taken, key=lambda k: (abs(k[0] - n), abs(k[1] - t)))
            assert abs(taken[key] - total) <= (near if near is not None else max(60, 0.5 * total))
    return taken


def test_query_over_awkward_rows(spark, tmp_path):
    rows = cases.awkward()
    sf = cases.save(cases.with_clashes(cases.frame(spark, rows)), tmp_path, "documents")
    first = mixing.op8_mix(spark, sf)
    # One document of 40,000 words can only be taken or left.
    check(spark, rows, first.collect(), near=20_000)
    check(spark, [r for r in rows if r[0] != 106], mixing.op8_mix(spark, cases.save(cases.frame(spark, [r for r in rows if r[0] != 106]), tmp_path / "short", "documents")).collect(), near=30)
    assert cases.rows_of(first) == cases.rows_of(mixing.op8_mix(spark, sf))


def test_taken_words_come_near_their_targets(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice((1, 5, 20, 80, 300))), "xx", r.choice("aaaaabcdef"), 1) for i in range(1500)]
    sf = cases.save(cases.frame(spark, rows), tmp_path, "documents")
    check(spark, rows, mixing.op8_mix(spark, sf).collect(), near=3)
    check(spark, rows, mixing.op8_mix(spark, cases.save(cases.frame(spark, rows, partitions=7), tmp_path, "documents")).collect(), near=3)


def test_order_does_not_matter(spark):
    rows = cases.awkward()
    one, two = (cases.rows_of(mixing.mix(cases.frame(spark, rows[::s], partitions=p))) for s, p in ((1, 2), (-1, 5)))
    assert one == two


def test_mix_repeats_rows(spark):
    rows = cases.awkward()
    docs = cases.with_clashes(cases.frame(spark, rows))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    found = mixing.plan(mixing.sized(docs)).select(F.col("law_source").alias("s2"), "target").distinct().collect()
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += count(r.text)
        assert count(r.text)
    for r in found:
        assert r.target == 0 or words[r.s2] > 0 or r.target < 50


def slow_choice(rows, starts):
    """rows: (key, source, size, u); starts: the random start of each source. Keys taken beyond the certain copies, by sorting everything."""
    sizes = defaultdict(int)
    for _, source, size, _ in rows:
        sizes[source] += size
    want, out = slow_targets(sizes), {}
    for source, whole in sizes.items():
        docs = [(k, n, u) for k, s, n, u in rows if s == source and n]
        if not whole:
            continue
        copies = min(3, int(want[source] // whole))
        missing = max(0.0, want[source] - copies * whole)
        out[source] = set()
        if missing <= 0:
            continue
        classes = defaultdict(list)
        for k, n, u in docs:
            classes[math.floor(math.log2(n) * mixing.STEPS)].append((k, n, u))
        above, proportion = 0, None
        for c in sorted(classes, reverse=True):
            own = (missing - above) / sum(n * n for d in classes if d <= c for _, n, _ in classes[d])
            if own * min(n for _, n, _ in classes[c]) < 1:
                proportion = own
                break
            above += sum(n for _, n, _ in classes[c])
        p = {k: min(1.0, proportion * n) for k, n, _ in docs}
        out[source] |= {k for k in p if p[k] == 1}
        open_, upto, plan = missing - sum(n for k, n, _ in docs if p[k] == 1), 0, []
        for c in sorted(classes, reverse=True):
            ranked = sorted(((u / (1 - u)) / (p[k] / (1 - p[k])), n, k) for k, n, u in classes[c] if p[k] < 1)
            units = sum(round(p[k] * mixing.GRAIN) for _, _, k in ranked)
            start = starts[source] * mixing.GRAIN
            fixed = math.floor((upto + units + start) / mixing.GRAIN) - math.floor((upto + start) / mixing.GRAIN)
            upto += units
            if units:
                cuts = [i for i in range(len(ranked) + 1) if abs(i - fixed) <= mixing.NEAR]
                plan.append((ranked, min(fixed, len(ranked)), cuts))
        words = lambda ranked, i: sum(n for _, n, _ in ranked[:i])
        open_ -= sum(words(r, f) for r, f, _ in plan)
        more = sum(words(r, cuts[-1]) - words(r, f) for r, f, cuts in plan)
        less = sum(words(r, f) - words(r, cuts[0]) for r, f, cuts in plan)
        for ranked, fixed, cuts in plan:
            base = words(ranked, fixed)
            gap, more, less = open_ + base, more - (words(ranked, cuts[-1]) - base), less - (base - words(ranked, cuts[0]))
            judge = lambda i: (max(gap - words(ranked, i) - more, words(ranked, i) - gap - less, 0), abs(gap - words(ranked, i)), abs(i - fixed))  # noqa: B023, E731
            best = min(cuts, key=judge)
            open_ = gap - words(ranked, best)
            out[source] |= {k for _, _, k in ranked[:best]}
    return out, {source: min(3, int(want[source] // n)) if n else 0 for source, n in sizes.items()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_sort_of_everything(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(r.lognormvariate(3, 1.3))), "xx", r.choice(["a"] * 6 + ["b", "c", None]), 1) for i in range(700)]
    docs = cases.frame(spark, rows)
    known = [(x.doc_id, x.source, x.size, x.u) for x in mixing.sized(docs).collect()]
    sources = sorted({s for _, s, _, _ in known}, key=repr)
    start = mixing.random_unit(F.lit(0), F.lit("start"), F.coalesce("source", F.lit("")))
    starts = {x.source: x.u for x in spark.createDataFrame([(s,) for s in sources], "source string").select("source", start.alias("u")).collect()}
    chosen, copies = slow_choice(known, starts)
    got = {x.doc_id: (x.taken // x.size if x.size else 0) for x in mixing.op8_mix(spark, cases.save(docs, tmp_path, "documents")).collect()}
    assert got == {k: (copies[s] + (k in chosen[s]) if n else 0) for k, s, n, _ in known}


def test_the_order_is_not_that_of_the_random_numbers(spark):
    """Documents of one class differ in size, so in their odds."""
    r = random.Random(2)
    docs = cases.frame(spark, [(i, " ".join(["w"] * r.randint(20, 23)), "xx", "ab"[i % 5 == 0], 1) for i in range(600)])
    rows = mixing.sized(docs)
    drawn = mixing._drawn(mixing._as_law(mixing.laws(rows)), rows).where("source = 'a' and p < 1").select("u", "q", "p", "step").collect()
    assert len({x.p for x in drawn}) > 1
    by_class = defaultdict(list)
    for x in drawn:
        by_class[x.step].append(x)
    assert any([x.u for x in sorted(xs, key=lambda x: x.q)] != sorted(x.u for x in xs) for xs in by_class.values())


def test_inclusion_frequencies(spark):
    """Over many seeds a document is taken about as often as its probability says."""
    rows = [(i, " ".join(["w"] * (2, 3, 5, 8, 13)[i % 5]), "xx", "ab"[i % 4 == 0], 1) for i in range(160)]
    docs = cases.frame(spark, rows, partitions=1).cache()
    law = mixing._as_law(mixing.laws(mixing.sized(docs)))
    expected = {x.doc_id: x.copies + x.p for x in mixing._drawn(law, mixing.sized(docs)).select("doc_id", "copies", "p").collect()}
    times, seeds = defaultdict(int), 8
    for seed in range(seeds):
        for x in mixing.mix(docs, seed=seed).groupBy("doc_id").count().collect():
            times[x.doc_id] += x["count"]
    # The smallest documents of a source settle its words, which moves their share by a document or so.
    for size in range(5):
        group = [i for i in range(160) if i % 5 == size and i % 4]
        assert sum(times[i] for i in group) / seeds / len(group) == pytest.approx(sum(expected[i] for i in group) / len(group), abs=0.15)
    assert len({times[i] for i in range(160) if i % 4}) > 2


def test_the_main_path_is_native(spark, tmp_path):
    sf = cases.save(cases.frame(spark), tmp_path, "documents")
    plan = mixing.op8_mix(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_wordless(spark, tmp_path):
    assert mixing.op8_mix(spark, cases.save(cases.frame(spark).limit(0), tmp_path, "documents")).count() == 0
    got = mixing.op8_mix(spark, cases.save(cases.frame(spark, [(1, None, None, None, None), (2, " ", "x", "a", 1)]), tmp_path, "documents")).collect()
    assert {(r.size, r.taken, r.target) for r in got} == {(0, 0, 0.0)}
