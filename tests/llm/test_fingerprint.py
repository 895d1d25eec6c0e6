import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keytide.llm import fingerprint
from keytide.llm.fingerprint import Tree, likeness

from . import cases


def texts():
    return [t or "" for _, t, *_ in cases.awkward(3, 20)]


def following(rows):
    """Each row with the next one's text: ids ascending, equal ids by a hash of their texts, null ids last."""
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))
    return [(*r[:2], order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]


def test_leaves_hold_every_byte():
    for t in texts():
        tree = Tree(t)
        assert sum(map(int, tree.sizes)) == len(t.encode())
        assert [p[1] for p in tree.paragraphs[1:]] == [p[2] for p in tree.paragraphs[:-1]] and (not tree.leaves or tree.paragraphs[-1][2] == len(tree.leaves))
        assert [s[1] for s in tree.sections[1:]] == [s[2] for s in tree.sections[:-1]]


def test_roots_test_equality():
    roots = {}
    for t in texts():
        for u in (t, t + " ", t + "\n", t[:-1], t.replace("a", "b", 1)):
            roots.setdefault(Tree(u).fingerprint(), set()).add(u)
    assert all(len(same) == 1 for same in roots.values())
    assert Tree("a\nb").root == Tree("a\nb").root


def test_likeness_follows_the_share_kept():
    r = random.Random(5)
    for words in (40, 400, 3000):
        a, b = cases.prose(r, words), cases.prose(random.Random(words + 99), words)
        tree = Tree(a)
        assert likeness(tree, Tree(a)) == 1.0 and likeness(tree, Tree(b)) < 0.35
        assert 0.6 <= likeness(tree, Tree(fingerprint.edited(a, b))) <= 0.95
        assert likeness(tree, Tree(a + " more")) > 0.85
    assert likeness(Tree(""), Tree("")) == 1.0 and likeness(Tree(""), Tree("x")) == 0.0


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.9])
def test_the_difference_is_located(share):
    a = cases.prose(random.Random(8), 600)
    at = int(share * len(a))
    b = a[:at] + "QQ" + a[at + 2 :]
    found = fingerprint.first_difference(Tree(a), Tree(b))
    assert found is not None and found <= at and at - found <= 80
    assert fingerprint.first_difference(Tree(a), Tree(a)) is None


def test_query_over_awkward_rows(spark, tmp_path):
    rows = cases.awkward()
    docs = cases.with_clashes(cases.frame(spark, rows))
    got = fingerprint.op3_fingerprint(spark, cases.save(docs, tmp_path, "documents")).collect()
    want = []
    for doc_id, text, after in following(rows):
        text, after = text or "", after or ""
        new = fingerprint.edited(text, after)
        trees = [Tree(x) for x in (text, new, after)]
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), trees[0].fingerprint(), trees[1].fingerprint(), likeness(*trees[:2]), likeness(trees[0], trees[2])))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compare(docs.limit(0)).count() == 0


def test_one_row_is_its_own_next(spark):
    r = fingerprint.compare(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_the_next_across_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i * 3 % 101, f"text {i} " * 5) for i in range(101)]
        got = {r.doc_id: r.edited_sha256 for r in fingerprint.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest() for i, t, n in following(rows)}


def test_hot_and_missing_ids_are_spread(spark):
    rows = [(i, f"text {i} " * 3) for i in range(60)] + [(7, f"seven {i}") for i in range(80)] + [(None, f"none {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        dealt = fingerprint.with_next(docs).groupBy("part").agg(F.count_if(F.col("doc_id") == 7).alias("seven"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.count_if(~F.col("tail")).alias("n")).collect()
        got = sorted(((r.doc_id, r.edited_sha256) for r in fingerprint.compare(docs).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.n for r in dealt) == len(rows)
    assert sum(r.seven > 3 for r in dealt) > 3 and sum(r.none > 3 for r in dealt) > 3
    assert got == sorted(((i, hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()) for i, t, n in following(rows)), key=repr)


def slow_likeness(a: str, b: str) -> float:
    """Bytes of the pieces that both texts have, piece by piece, by taking them off one at a time."""

    def pieces(t):
        ends = np.cumsum(t.sizes).tolist()
        return [t.data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    one, two = pieces(Tree(a)), pieces(Tree(b))
    both = 0
    for piece in one:
        if piece in two:
            two.remove(piece)
            both += len(piece)
    return 2 * both / (len(a.encode()) + len(b.encode()))


def test_likeness_is_that_of_the_pieces_in_common():
    """Comparing from the top, branch by branch, comes to the same but for pieces that moved between unlike branches."""
    r = random.Random(6)
    for _ in range(60):
        a = cases.prose(r, 200)
        at = r.randrange(len(a) - 60)
        b = a[:at] + cases.prose(r, 5) + a[at + r.randrange(60) :]
        assert likeness(Tree(a), Tree(b)) == pytest.approx(slow_likeness(a, b), abs=0.02)


def test_inner_digests_are_those_of_their_children():
    """The tree built anew from its leaves by its definition."""
    r = random.Random(9)
    for text in ("", "a", "one two\n\nthree", *(cases.prose(r, n) for n in (10, 300, 3000))):
        t = Tree(text)
        inner = lambda mark, parts: hashlib.blake2b(mark + b"".join(parts), digest_size=16).digest()
        data, leaves, at = text.encode(), [], 0
        for n in t.sizes.tolist():
            leaves.append(data[at : at + n])
            at += n
        assert at == len(data)
        lines: list[list[bytes]] = [[]]
        for i, leaf in enumerate(leaves):
            lines[-1].append(leaf)
            if leaf.endswith(b"\n") and i + 1 < len(leaves):
                lines.append([])
        paragraphs = [(inner(b"P", [xxhash.xxh3_128_digest(x) for x in line]), line) for line in lines if line]
        sections: list[list[bytes]] = [[]]
        for i, (digest, line) in enumerate(paragraphs):
            sections[-1].append(digest)
            if (len(line) == 1 and len(line[0]) <= 1 or digest[0] % fingerprint.SECTION == 0) and i + 1 < len(paragraphs):
                sections.append([])
        assert t.fingerprint() == inner(b"D", [inner(b"S", s) for s in sections if s]).hex()
