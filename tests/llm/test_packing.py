import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from keytide.llm import packing

from . import cases


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(tokenizer, monkeypatch):
    known = packing.Tokens(packing.default_tokenizer())
    r = random.Random(2)
    alphabet = [*"ab'stredmlv 0129_-!\t\n\x0b\x1c\x85 ²½ªºßÀéİıǅſȺ́ͅΑΣς中😀<|>", "<|endoftext|>", "'re"]
    texts = [t for _, t, *_ in cases.awkward()] + ["".join(r.choice(alphabet[: r.choice((16, 24, 60))]) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    want = [ids_of(tokenizer, t) for t in texts]
    assert known._by_words and [x.tolist() for x in known.encode(texts)] == want
    monkeypatch.setattr(packing, "CACHE", 10)
    monkeypatch.setattr(packing, "TAKE", 50)
    small = packing.Tokens(packing.default_tokenizer())
    assert [x.tolist() for x in small.encode(texts)] == want


def test_other_tokenizers_are_read_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, known = Tokenizer.from_file(path), packing.Tokens(path)
    texts = ["Upper and lower", "it's 42!", " two  spaces ", None, "é\n"]
    assert not known._by_words and [x.tolist() for x in known.encode(texts)] == [ids_of(other, t) for t in texts]


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice((10, 64, 2048))
    counts = Counter(min(capacity, max(1, int(r.expovariate(4 / capacity)))) for _ in range(r.choice((1, 30, 400))))
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    simple = packing.best_fit(dict(counts), capacity)
    assert sum(n for _, n in simple) == slow_best_fit(list(counts.elements()), capacity)
    for plan in (simple, packing.solve(dict(counts), capacity)):
        placed = Counter()
        for content, number in plan:
            assert number > 0 and sum(x * n for x, n in content.items()) <= capacity
            placed.update({x: n * number for x, n in content.items()})
        assert placed == counts
        assert bound <= sum(n for _, n in plan) <= max(1.02 * sum(n for _, n in simple), sum(n for _, n in simple) + 1)


def slow_value(prices, capacity):
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(p + best[c - x] for x, p in prices.items() if x <= c)])
    return best


def test_knapsack_table():
    r = random.Random(1)
    for _ in range(20):
        prices = {x: r.random() for x in r.sample(range(1, 30), 6)}
        dense = np.full(41, -np.inf)
        dense[list(prices)] = list(prices.values())
        table = packing.best_values(dense)
        assert table[::-1].tolist() == pytest.approx(slow_value(prices, 40))
        first = r.choice(list(prices))
        found = packing.completed(first, dense, table, dict.fromkeys(prices, 99))
        assert sum(x * n for x, n in found.items()) <= 40
        assert sum(prices[x] * n for x, n in found.items()) == pytest.approx(prices[first] + slow_value(prices, 40)[40 - first])
        few = packing.completed(first, dense, table, dict.fromkeys(prices, 1))
        assert set(few.values()) == {1} and np.isfinite(dense).sum() == 6


@pytest.mark.parametrize("seed", range(4))
def test_the_fraction_covers_and_its_bound_holds(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(3, 70) for _ in range(300))
    found, bound, prices, top = packing.fractional(dict(counts), 100)
    covered = Counter()
    for key, times in found.items():
        assert sum(x * n for x, n in key) <= 100
        for x, n in key:
            covered[x] += n * times
    assert all(covered[x] >= n - 1e-6 for x, n in counts.items())
    # No plan has fewer sequences than the bound, and the prices prove it.
    assert bound == pytest.approx(sum(n * prices[x] for x, n in counts.items()) / top)
    assert bound <= sum(found.values()) <= 1.25 * bound and bound <= sum(n for _, n in packing.best_fit(dict(counts), 100))


def test_configurations_beat_best_fit_where_it_errs():
    """Best fit in falling length pairs the largest first; six to a pattern need the right three together."""
    counts = {44: 60, 24: 60, 32: 120, 34: 60, 22: 120, 33: 60, 12: 60}
    assert sum(n for _, n in packing.solve(counts, 100)) < sum(n for _, n in packing.best_fit(counts, 100))


def test_most_pieces_of_real_lengths_are_placed_by_configurations():
    """Lengths of the documents of a whole table, by characters: near the bound, and by the program rather than by best fit."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    counts: Counter = Counter()
    for t in texts:
        n = len(t or "") // 3 + 1
        counts.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    short = {x: n for x, n in counts.items() if x < 2048}
    plan, left, bound = packing.configurations(short)
    assert left.total() <= 0.1 * sum(short.values())
    least = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert math.ceil(bound) + counts[2048] <= least + 1
    assert sum(n for _, n in packing.solve(dict(counts))) <= 1.001 * least + 1


def test_query_over_awkward_rows(spark, tmp_path, tokenizer):
    rows = cases.awkward()
    got = packing.op9_pack(spark, cases.save(cases.with_clashes(cases.frame(spark, rows)), tmp_path, "documents")).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array([*ids_of(tokenizer, text), 0], dtype="<u4")
        want += [(doc_id, i, at, len(part := ids[at : at + 2048]), zlib.crc32(part.tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= slow_best_fit([r.length for r in got], 2048) + 1


def test_hot_length_and_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, concat('w', id), 'same words here') as text")
    got = packing.pack(docs).collect()
    assert len(got) == 900 and len({(r.sequence_id, r.offset) for r in got}) == 900
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)
    assert packing.op9_pack(spark, cases.save(cases.frame(spark).limit(0), tmp_path, "documents")).count() == 0
