import base64
import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from keytide import config, model
from keytide.operators import metrics, progress, reads, segments, state
from keytide.operators.consistency import BarrierTimeout, KvReader, wait_applied
from keytide.plans import sqlviews
from keytide.sources import commands as source
from keytide.sources import log as stored

from .model_log import SCHEMA, live, replay, rows, sequence


def frame(spark, log):
    return spark.createDataFrame(log, SCHEMA).repartition(3)


@pytest.mark.parametrize("strategy", ["window", "aggregate", "rejoin"])
def test_state_equals_replay(spark, strategy):
    log = sequence(1)
    got = {r.key: (None if r.value is None else bytes(r.value), r.version, r.deleted) for r in state.state(frame(spark, log), strategy).collect()}
    assert got == replay(log)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        state.state(frame(spark, sequence(1)), "guess")


@pytest.mark.parametrize("seed", [2, 3])
def test_past_states(spark, seed):
    log = sequence(seed)
    cmds = frame(spark, log).cache()
    for upto in (0, log[0][0], log[len(log) // 2][0], log[-1][0] + 5):
        assert rows(state.live(state.as_of(cmds, upto))) == live(log, upto)


def test_replayed_log_is_idempotent(spark):
    log = sequence(4)
    assert rows(state.live(frame(spark, log + log[::2]))) == live(log)


def test_get(spark):
    log = sequence(5)
    cmds, want = frame(spark, log), replay(log)
    asked = [*want, "absent", ""]
    got = {r.key: r for r in reads.multi_get(cmds, spark.createDataFrame([(k,) for k in asked + asked], "key string")).collect()}
    assert set(got) == set(asked)
    for k in asked:
        value, version, dead = want.get(k, (None, None, True))
        assert (got[k].found, got[k].version) == (not dead, version)
        assert (None if got[k].value is None else bytes(got[k].value)) == value
    one = reads.get(cmds, "absent").collect()
    assert [(r.key, r.found, r.value, r.version) for r in one] == [("absent", False, None, None)]


def test_scans(spark):
    log = sequence(6)
    cmds, want = frame(spark, log), live(log)
    as_list = lambda df: [(r.key, bytes(r.value), r.version) for r in df.collect()]
    order = sorted(want, key=lambda x: x[0].encode())
    assert as_list(reads.scan_prefix(cmds)) == order
    for start, end, limit in itertools.product(("", "a/", "zz"), ("", "b"), (0, -1, 3, 1000)):
        expected = [x for x in order if x[0].encode() >= start.encode() and (not end or x[0].encode() < end.encode())]
        assert as_list(reads.scan_range(cmds, start, end, limit)) == (expected[:limit] if limit > 0 else expected)
    assert as_list(reads.scan_prefix(cmds, "user:1")) == [x for x in order if x[0].startswith("user:1")]
    assert as_list(reads.scan_from(cmds, "user:1")) == [x for x in order if x[0].encode() >= b"user:1"]


def test_key_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, sequence(6)).write.parquet(str(tmp_path / "log"))
    cmds = spark.read.parquet(str(tmp_path / "log"))
    plan = reads.scan_prefix(cmds, "user")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,user)" in plan
    plan = state.live(cmds).where("key = 'a'")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan
    plan = state.state(cmds).select("key", "version")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rejects(spark):
    df = spark.createDataFrame([(1, "put", "a", b"x"), (2, "put", "", b"x"), (3, "merge", "b", b"x"), (None, "put", "c", b"x"), (4, "delete", "a", b"old"), (5, "put", "d", None), (6, "put", None, b"")], "v long, o string, k string, x binary")
    valid, rejected = source.commands(df, "k", "v", "x", F.col("o"))
    assert [(r.version, r.op, r.key, r.value) for r in valid.orderBy("version").collect()] == [(1, "put", "a", b"x"), (4, "delete", "a", None), (5, "put", "d", b"")]
    assert sorted((r.version or 0, r.reason) for r in rejected.collect()) == [(0, "no version"), (2, "empty key"), (3, "unknown operation"), (6, "empty key")]


def test_command_json_round_trip(spark):
    log = sequence(7)
    encoded = source.encode(frame(spark, log))
    payload = {r.version: r.payload for r in encoded.collect()}
    assert all('"ttl"' not in p for p in payload.values()) and any('"v"' not in p and '"t":0' in p for p in payload.values())
    bad = encoded.unionByName(spark.createDataFrame([(10_000, "{nonsense"), (10_001, '{"t":9,"k":"x"}')], encoded.schema))
    valid, rejected = source.decode(bad)
    assert rows(state.live(valid)) == live(log)
    assert {r.version for r in rejected.collect()} == {10_000, 10_001}


def _parts(spark, log, n):
    base = frame(spark, log).select("key", "value", "version", (F.col("op") == "delete").alias("deleted"), (F.col("version") % n).alias("segment_id"))
    return state.latest(base.withColumn("both", F.struct("segment_id", "key")), key="both").drop("both")


def test_layers_merge_by_version(spark):
    log = sequence(8)
    parts = _parts(spark, log, 3)
    merged = state.merge_layers([parts.where(F.col("segment_id") == i) for i in range(3)])
    assert rows(merged.where("not deleted")) == live(log)
    old, new = (spark.createDataFrame([("k", v, 5, False)], model.STATE) for v in (b"old", b"new"))
    assert bytes(state.merge_layers([new, old]).first().value) == b"new"


@pytest.mark.parametrize("chosen", list(itertools.chain.from_iterable(itertools.combinations(range(4), r) for r in (1, 2, 3))))
def test_partial_compaction_keeps_the_live_view(spark, chosen):
    log = sequence(9, 120)
    parts = _parts(spark, log, 4).cache()
    compacted = segments.compact(parts.where(F.col("segment_id").isin(*chosen)), full=False).withColumn("segment_id", F.lit(9))
    rest = parts.where(~F.col("segment_id").isin(*chosen))
    assert rows(segments.merge_segments(rest.unionByName(compacted)).where("not deleted")) == live(log)


def test_dropping_tombstones_early_would_resurrect(spark):
    log = [(1, "put", "k", b"x", None), (2, "delete", "k", None, None)]
    parts = _parts(spark, log, 2)
    wrong = segments.compact(parts.where("segment_id = 0"), full=True).withColumn("segment_id", F.lit(9))
    assert rows(segments.merge_segments(parts.where("segment_id = 1").unionByName(wrong)).where("not deleted")) == [("k", b"x", 1)]
    assert segments.compact(parts, full=True).count() == 0


def test_segments_on_disk(spark, tmp_path):
    log, path = sequence(10), str(tmp_path / "s")
    for i, lo in enumerate(range(0, 200, 50)):
        segments.write_segment(state.state(frame(spark, log[lo : lo + 50])), path, i, partitions=2, expected_keys=50)
    segments.write_segment(state.state(frame(spark, log[:50])), path, 0, partitions=2, expected_keys=50)  # again, as a repeated batch would
    assert rows(segments.merge_segments(segments.read_segments(spark, path)).where("not deleted")) == live(log)
    stats = segments.segment_stats(segments.read_segments(spark, path)).collect()
    assert [r.segment_id for r in stats] == [3, 2, 1, 0]
    assert segments.compact_tier(spark, path, 9) and len(segments.compact_tier(spark, str(tmp_path / "s"), 10, segments=99)) == 0


def test_select_tier(spark):
    pick = lambda sizes: [r.segment_id for r in segments.select_tier(spark.createDataFrame(list(enumerate(sizes)), "segment_id long, bytes long")).collect()]
    assert pick([10, 100, 50, 20, 101]) == [0, 3, 2, 1]
    assert pick([10, 100, 101, 20]) == []
    assert pick([5, 5, 5]) == []


def test_snapshots(spark, tmp_path):
    log = sequence(11)
    cmds, path = frame(spark, log), str(tmp_path / "snap")
    middle = log[100][0]
    top = segments.write_snapshot(state.as_of(cmds, middle), path)
    assert top == middle
    snapshot, version = segments.read_snapshot(spark, path)
    assert rows(snapshot) == live(log, middle)
    assert rows(state.snapshot_plus_tail(snapshot, version, cmds)) == live(log)
    (tmp_path / "snap.json").write_text(segments.dump_json_array(snapshot))
    assert rows(segments.read_snapshot_json(spark, str(tmp_path / "snap.json"))) == live(log, middle)


def test_views(spark):
    log = sequence(12)
    sqlviews.register(frame(spark, log), "t")
    assert spark.sql("select count(*) from t_live").first()[0] == len(live(log))
    assert spark.sql("select count(*) from t_state").first()[0] == len(replay(log))


def test_barriers(spark):
    log = sequence(13)
    cmds = frame(spark, log)
    gaps = sorted(set(range(1, log[-1][0])) - {n for n, *_ in log})
    reader = KvReader(lambda: cmds, gaps=spark.createDataFrame([(n,) for n in gaps], "version long"))
    key = live(log)[0][0]
    top = log[-1][0]
    for kwargs in ({}, {"mode": "strong"}, {"mode": "read-your-writes", "session_index": top}, {"mode": "monotonic", "min_version": 0}):
        assert reader.get(key, **kwargs).first().found
    with pytest.raises(BarrierTimeout):
        reader.get(key, "read-your-writes", session_index=top + 1, timeout=0.2)
    with pytest.raises(ValueError):
        reader.get(key, "monotonic")
    with pytest.raises(ValueError):
        reader.get(key, "sometimes")
    assert model.resolve_mode("sometimes", lenient=True) == "eventual"
    assert model.resolve_mode("", "strong") == "strong" and model.resolve_mode("eventual", "strong") == "eventual"
    assert not reader.get("").first().found
    now = iter([0, 1, 2, 3])
    assert wait_applied(lambda: next(now), 3, poll=0) == 3
    with pytest.raises(ValueError):
        wait_applied(lambda: 0, -1)
    began = time.monotonic()
    assert wait_applied(lambda: 1 / 0, 0) == 0 and time.monotonic() - began < 1
    assert reader.scan("user:", 1).count() <= 1


def test_a_greater_version_does_not_stand_for_a_lesser(spark):
    """A log that holds version 10 alone hasn't applied version 3."""
    cmds = spark.createDataFrame([(10, "put", "a", b"x", None)], SCHEMA)
    with pytest.raises(BarrierTimeout):
        KvReader(lambda: cmds).get("a", "read-your-writes", session_index=3, timeout=0.1)
    assert KvReader(lambda: cmds).get("a").first().found
    gaps = spark.range(1, 10).select(F.col("id").alias("version"))
    assert KvReader(lambda: cmds, gaps=gaps).get("a", "read-your-writes", session_index=10, timeout=0.1).first().found


@pytest.mark.parametrize("seed", range(5))
def test_marks_equal_a_count(spark, seed):
    r = random.Random(seed)
    versions = [v for v in range(1, r.choice((3, 64, 65, 200))) if r.random() < r.choice((0.97, 0.999, 1))]
    cmds = spark.createDataFrame([(v,) for v in versions + versions[:3]], "version long")
    want = 0
    while want + 1 in versions:
        want += 1
    noted = progress.blocks(cmds)
    assert progress.mark_of(noted) == want
    for earlier in {0, want // 2, want, max(0, want - 1)}:
        assert progress.mark_of(progress.united(noted, earlier), earlier) == want
    assert progress.mark_of(noted.limit(0), 130) == 130 and progress.mark_of(noted.limit(0)) == 0


def test_log_appends(spark, tmp_path):
    log = stored.Log(spark, str(tmp_path / "log"), partitions=2)
    assert log.last_version() == 0 and log.read().count() == 0
    rows_ = [(3, "put", "b", b"2", None), (1, "put", "a", b"1", 60), (2, "delete", "a", None, None), (4, "put", "", b"x", None), (5, "merge", "c", b"x", None)]
    df = spark.createDataFrame(rows_, "n long, op string, k string, v binary, ttl long").repartition(3)
    first = log.append(df, "k", "v", F.col("op"), F.col("ttl"), "n")
    assert (first.first, first.last) == (1, 3) and {r.reason for r in first.rejected.collect()} == {"empty key", "unknown operation"}
    assert [tuple(r) for r in log.read().orderBy("version").collect()] == [(1, "put", "a", b"1", 60), (2, "delete", "a", None, None), (3, "put", "b", b"2", None)]
    assert log.append(df.where("n > 3"), "k", "v", F.col("op"), order="n").last == 3
    second = log.append_versioned(spark.createDataFrame([(9, "put", "z", b"", None), (2, "put", "old", b"", None)], SCHEMA))
    assert (second.first, second.last) == (9, 9) and [r.reason for r in second.rejected.collect()] == ["old version"]
    (tmp_path / "log" / "append=000000000002").mkdir()  # left by an append that died before it was committed
    assert log.append(df.where("n = 1"), "k", "v", F.col("op"), order="n").first == 10
    assert sorted(r.version for r in log.read().collect()) == [1, 2, 3, 9, 10]
    plan = reads.get(log.read(), "a")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan


def test_batcher(spark, tmp_path):
    now = iter([0.0, 0.001, 0.0015, 10.0, 10.1])
    log = stored.Log(spark, str(tmp_path / "log"), partitions=1)
    batcher = stored.Batcher(log, config.Config(flush_commands=3, flush_ms=50), clock=lambda: next(now))
    assert batcher.put("a", b"1") is None and batcher.delete("a") is None
    done = batcher.put("b", b"2")
    assert (done.first, done.last) == (1, 3) and batcher.flush() is None
    assert batcher.put("c", b"") is None and batcher.put("d", b"", 5).last == 5  # the first of them has waited too long
    for wrong in (lambda: batcher.put("", b"x"), lambda: batcher.submit("merge", "k", b"")):
        with pytest.raises(ValueError):
            wrong()
    assert [(r.version, r.op, r.key) for r in log.read().orderBy("version").collect()] == [(1, "put", "a"), (2, "delete", "a"), (3, "put", "b"), (4, "put", "c"), (5, "put", "d")]


def test_snapshots_are_kept(spark, tmp_path):
    cmds, path = frame(spark, [(i + 1, *x[1:]) for i, x in enumerate(sequence(15, 100))]), str(tmp_path / "s")
    taken = [segments.keep_snapshots(state.as_of(cmds, v), path, 20, 3) for v in (10, 25, 30, 45, 70, 100)]
    assert taken == [None, 25, None, 45, 70, 100] and segments.snapshots(spark, path) == [45, 70, 100]


def test_entries_and_json(spark):
    log = sequence(16)
    got = [(r.key, r.version, r.deleted) for r in reads.scan_entries(frame(spark, log), "a", "user", 5).collect()]
    want = sorted(((k, v, d) for k, (_, v, d) in replay(log).items() if "a" <= k < "user"), key=lambda x: x[0].encode())
    assert got == want[:5] and any(d for _, _, d in want)
    shown = [json.loads(r.json) for r in reads.as_json(reads.scan_prefix(frame(spark, log))).collect()]
    assert sorted((x["key"], base64.b64decode(x["value"]), x["version"]) for x in shown) == live(log)


def test_metrics(spark):
    values = [0.1, 0.2, 0.2, 3.0, 100.0, None, 0.05] * 3
    df = spark.createDataFrame([(v, "x" if i % 2 else "y") for i, v in enumerate(values)], "v double, label string")
    got = {(r.label, r.le): r.cumulative for r in metrics.latency_histogram(df, "v", ["label"], 0.05, count=5).collect()}
    for label in "xy":
        own = [v for i, v in enumerate(values) if v is not None and ("x" if i % 2 else "y") == label]
        for le in [0.05 * 2**i for i in range(5)] + [float("inf")]:
            assert got[label, le] == sum(v <= le for v in own)
    known = sorted(v for v in values if v is not None)
    for r in metrics.percentiles(df, "v", [0.0, 0.5, 0.99, 1.0]).collect():
        assert r.value == known[min(int(len(known) * r.p), len(known) - 1)]
    assert metrics.percentiles(df.limit(0), "v", [0.5]).count() == 0
    equal = spark.range(500).select(F.lit(7.0).alias("v"))
    assert [r.value for r in metrics.percentiles(equal, "v", [0.5, 0.99]).collect()] == [7.0, 7.0]


def test_memtable_size_and_status(spark):
    log = [(1, "put", "ab", b"xyz", None), (2, "put", "ab", b"longer", None), (3, "delete", "new", None, None)]
    cmds = frame(spark, log)
    assert metrics.memtable_size(cmds).first().asDict() == {"keys": 2, "bytes": 2 + 3 + 24 + 3 + 24}
    s = metrics.status(cmds, state.as_of(cmds, 2), peers=("n2",)).first()
    assert (s.commit_index, s.applied_index, s.ready, s.keys, s.live_keys, s.peers) == (3, 2, True, 2, 1, ["n2"])
    empty = metrics.status(cmds.limit(0)).first()
    assert (empty.commit_index, empty.ready, empty.keys) == (0, False, 0)


def test_members(spark):
    df = spark.createDataFrame([('{"id":"a","raft":"r","grpc":"g"}',), ("bad",), (None,)], "meta string")
    assert [tuple(r) for r in segments.members(df).collect()] == [("a", "r", "g")]


def test_config():
    c = config.load({"node_id": "n1", "scan_limit": "7"}, {"KEYTIDE_BLOOM_FPP": "0.05", "KEYTIDE_NODE_ID": "n2"})
    assert (c.node_id, c.scan_limit, c.bloom_fpp, c.tier_segments) == ("n2", 7, 0.05, 4)
    with pytest.raises(ValueError):
        config.load({"nod_id": "x"}, {})
