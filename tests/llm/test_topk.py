import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keytide.llm import topk

from . import cases

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def slow(rows, k, asks):
    """Every query against every other row, in Python's integers."""
    scaled = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and usable(v)]
    queries = {}
    for i, v in scaled:
        if asks(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in scaled if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def vectors(seed, n, width=8):
    """Clusters of several lengths, copies, zeros and ties."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, width))
    rows = []
    for i in range(n):
        v = (centers[i % 5] + 0.05 * r.normal(size=width)) * (1, 1, 3, 0.2)[i % 4] if i % 3 else r.normal(size=width)
        rows.append((i, [float(x) for x in np.float32(v)], 0))
    rows += [(n + i, rows[3][1], 0) for i in range(30)] + [(n + 100 + i, [0.0] * width, 0) for i in range(12)]
    return rows


@pytest.mark.parametrize("block, seeds", [(1 << 18, 1 << 17), (64 * 8, 16 * 8), (32 * 8, 3 * 8)])
def test_equals_brute_force(spark, monkeypatch, block, seeds):
    """block, seeds: also with many blocks and with first scores that say little."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "FOCUS", 3)
    rows = vectors(block, 600)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 20 == 0, k=7)
    assert sorted(map(tuple, got.collect())) == slow(rows, 7, lambda i: i % 20 == 0)


def test_pruning_by_coordinates_loses_nothing(monkeypatch):
    monkeypatch.setattr(topk, "FOCUS", 3)
    r = np.random.default_rng(3)
    c = np.floor(1024 * np.vstack([r.normal(size=(300, 6)), 1 + 0.01 * r.normal(size=(50, 6))]))
    block = topk.Block(c, np.arange(len(c)))
    q = np.floor(1024 * (1 + 0.01 * r.normal(size=(10, 6))))
    scores = (q @ c.T).astype(int)
    for share in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
        least = np.array([share * s.max() for s in scores])
        for steep, failed in ((np.inf, -np.inf), (-np.inf, -np.inf), (np.inf, np.inf)):
            block.steep, block.failed = steep, failed
            got = topk.search_block(q, np.arange(1000, 1010), least, block, 1000)
            want = sorted((1000 + i, j, int(s)) for i, row in enumerate(scores) for j, s in enumerate(row) if s >= least[i])
            assert sorted(zip(*got, strict=True)) == want


def test_blocks_prune_by_coordinates_where_thresholds_are_high(spark):
    """Clusters of many lengths: most products are never taken."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(40, 64))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    rows = [(i, [float(x) for x in np.float32((centers[i % 40] + 0.03 * r.normal(size=64)) * r.lognormal(0, 0.7))], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert 0 < topk.verified_share(df, F.col("id") % 100 == 0) < 0.5
    level = spark.createDataFrame([(i, [float(x) for x in np.float32(np.array(v) / np.linalg.norm(v))], 0) for i, v, _ in rows], SCHEMA)
    assert 0 < topk.verified_share(level, F.col("id") % 100 == 0) < 0.9  # equal lengths: by coordinates alone
    got = topk.top_k(df, F.col("id") % 1000 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == slow(rows, 5, lambda i: i % 1000 == 0)


def test_floors_are_exact(spark):
    """Tiny, huge and denormal components against whole numbers."""
    values = [0.0, -0.0, 5e-324, -5e-324, -1e-20, 1e-20, -0.5 / 1024, 1 / 1024, -1 / 1024, 2.0**43, -(2.0**43) - 0.5, 1e300, -1e300, 1.7e308]
    scaled = lambda x: math.floor(x * 1024) if math.isfinite(x * 1024) else int(math.copysign(np.finfo(float).max, x))
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(values)], "id long, v array<double>")
    got = {r.id: int(r.v[0]) for r in topk._scaled(df, "id", "v", 1024).collect()}
    assert got == {i: scaled(x) for i, x in enumerate(values)}
    rows = [(0, [1.0, 1.0]), (1, [1.0, -1e-20]), (2, [1.0, 0.0]), (3, [1.0, 5e-324])]
    best = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(best, key=lambda r: r["rank"])] == [(2, 1048576), (3, 1048576), (1, 1047552)]


def test_query_over_awkward_rows(spark, tmp_path):
    rows = vectors(1, 120)
    rows += [(300, None, 1), (400, [1.0, None], 1), (500, [float("nan")] * 8, 1), (600, [float("inf")] * 8, 1), (700, [], 1), (800, [1.0, 2.0], None), (None, [1.0] * 8, 1)]
    rows += [(-100, rows[5][1], 1), (-100, rows[6][1], 1), (901, rows[7][1], 1), (901, rows[7][1], 1)]
    table = cases.with_clashes(cases.frame(spark, rows, SCHEMA))
    got = topk.op10_topk(spark, cases.save(table, tmp_path, "embeddings"))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == slow(rows, 10, lambda i: i % 100 == 0)
    assert topk.top_k(table.limit(0), F.col("id") % 100 == 0).count() == 0
    few = topk.top_k(spark.createDataFrame(rows[:3], SCHEMA), F.col("id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = c.sql(topk.ORACLES["op10_topk"]).fetchall()
    assert sorted(map(tuple, topk.op10_topk(spark, folder).collect())) == sorted(want)
