import struct

import pytest
from pyspark.sql import functions as F

from tideline.functions.murmur import with_murmur3
from tideline.operators import indexes, oplog, runs
from tideline.sources.adapters import ops_events
from tideline.sources.config import Config
from tideline.sources.pairs import read_pairs, read_run, write_pairs, write_run
from tideline.sources.store import Store
from tideline.streaming.latest import stream_latest
from conftest import SMALL
from test_oplog import LOG, log, model


def murmur(key: int, seed: int) -> int:
    mask = (1 << 32) - 1
    rot = lambda x, n: (x << n | x >> (32 - n)) & mask
    k = rot((key & mask) * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h = (rot(seed ^ k, 13) * 5 + 0xE6546B64) & mask ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def test_murmur(spark):
    keys = [0, 1, -1, 7, 123456789, -(1 << 31), (1 << 31) - 1]
    df = spark.createDataFrame([(k, s) for k in keys for s in range(7)] + [(None, 0)], "k int, s int")
    found = with_murmur3(df, F.col("k"), F.col("s"), "h")
    for r in found.collect():
        assert r["h"] == (None if r["k"] is None else murmur(r["k"], r["s"]))
    builtin = with_murmur3(df.where("k is not null"), F.col("k"), F.lit(42), "b").select(F.hash("k").cast("long").bitwiseAND(F.lit((1 << 32) - 1)).alias("a"), "b")
    assert all(r["a"] == r["b"] for r in builtin.collect())
    assert len(plan(found)) < 10_000  # the steps stay apart


def test_bloom_has_no_false_negatives(spark):
    flushed = runs.flushed(ops_events(spark, SMALL), 100)
    bits, hashes = indexes.bloom_bits(F.lit(100), F.lit(0.01)), indexes.bloom_hashes(F.lit(0.01))
    maybe = indexes.bloom_probe(indexes.bloom_filter(flushed, bits, hashes), flushed.select("key"), bits, hashes)
    assert flushed.join(maybe, ["run_id", "key"], "left_anti").count() == 0


def test_bloom_probe_stays_small(spark):
    """The hash's steps are not copied into the joins' conditions."""
    from tideline.plans.catalogue import bloom_probe

    assert len(plan(bloom_probe(spark, SMALL))) < 20_000


def test_fences(spark, rows):
    run = spark.createDataFrame([(1, k, False, 0) for k in range(0, 50, 5)] + [(2, 3, False, 0)], "run_id int, key int, is_delete boolean, value int")
    pages = indexes.fence_pages(run, 4)
    assert rows(pages, "run_id", "page", "page_max") == [(1, 0, 15), (1, 1, 35), (1, 2, 45), (2, 0, 3)]
    found = indexes.fence_lookup(pages, spark.createDataFrame([(-1,), (15,), (16,), (46,)], "key int"), 4)
    assert rows(found.where("run_id = 1"), "key", "page", "address") == [(-1, 0, 0), (15, 0, 0), (16, 1, 48), (46, None, None)]


def test_pair_files(spark, rows, tmp_path):
    pairs = [(0, 5, 1), (1, -7, 2), (2, 5, 3)] + [(k, k % 11, k) for k in range(3, 2000)]
    write_pairs(spark.createDataFrame(pairs, "seq long, key int, value int").repartition(5), str(tmp_path / "p"))
    assert rows(read_pairs(spark, str(tmp_path / "p")), "seq", "key", "value") == pairs
    one = tmp_path / "one.bin"
    one.write_bytes(struct.pack("<iiii", 1, 10, -3, 7) + b"abc")
    assert rows(read_pairs(spark, str(one)), "seq", "key", "value") == [(0, 1, 10), (1, -3, 7)]
    (tmp_path / "empty.bin").write_bytes(b"")
    assert read_pairs(spark, str(tmp_path / "empty.bin")).count() == 0
    with pytest.raises(Exception, match="Could not read"):
        read_pairs(spark, str(tmp_path / "none.bin")).count()


def test_run_files(spark, rows, tmp_path):
    records = [(-5, True, None), (1, False, 10), (2, False, 0)]
    write_run(spark.createDataFrame(records[::-1], "key int, is_delete boolean, value int"), str(tmp_path / "r"))
    assert rows(read_run(spark, str(tmp_path / "r")), "key", "is_delete", "value") == records
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").glob("part-*")))
    assert raw == struct.pack("<9i", -5, 0, 1, 1, 10, 0, 2, 0, 0)


def test_store(spark, rows, tmp_path):
    ops = [(k * 7 % 13, k % 5 == 0, k) for k in range(60)]
    store = Store(spark, str(tmp_path / "s"), Config(ratio=2), files_per_run=2, flush_every=1)
    df, seen = log(spark, ops), []
    for at in range(0, 60, 5):
        store.write(df.where(f"seq >= {at} and seq < {at + 5}"))
        seen = ops[: at + 5]
        if at in (0, 20, 55):
            want = {k: v for k, v in model(seen).items() if v is not None}
            assert rows(store.state(), "key", "value") == sorted(want.items())
    again = Store(spark, str(tmp_path / "s"), Config(ratio=2))
    want = {k: v for k, v in model(ops).items() if v is not None}
    assert {k: again.get(k) for k in range(-1, 14)} == {k: want.get(k) for k in range(-1, 14)}
    assert [tuple(r) for r in again.range(3, 9).collect()] == sorted((k, v) for k, v in want.items() if 3 <= k < 9)
    levels = {}
    for r in again.manifest().runs:
        levels[r.level] = levels.get(r.level, 0) + 1
    assert levels == {x.level: x.runs for x in runs.layout(12, 2)}
    assert again.level_pairs() == {r["level"]: r["n"] for r in again.held().where("not is_delete").groupBy("level").agg(F.count("*").alias("n")).collect()}
    there = {int(x.removeprefix("run=")) for x in again.files.names(f"{again.root}/runs")}
    m = again.manifest()
    assert there == {r.run_id for r in m.runs} | {r for r, _ in m.retired} and all(m.version - 3 <= v <= m.version for _, v in m.retired)
    assert len(again.files.names(f"{again.root}/manifest")) - sum(x.endswith(".crc") for x in again.files.names(f"{again.root}/manifest")) == 4
    again.clear()
    assert again.manifest().runs == [] and again.state().count() == 0


def test_store_ignores_what_no_manifest_lists(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame([(0, 1, False, 2)], LOG))
    store._write_run(spark.createDataFrame([(1, False, 9)], "key int, is_delete boolean, value int"), 1, 77)  # a writer that died before it published
    assert store.files.write_new(f"{store.root}/manifest/v9.json", "{")  # and one that died over it
    assert rows(store.state(), "key", "value") == [(1, 2)]
    store.write(spark.createDataFrame([(1, 5, False, 6)], LOG))
    assert rows(store.state(), "key", "value") == [(1, 2), (5, 6)] and store.manifest().version == 10
    assert not store.files.write_new(f"{store.root}/manifest/v10.json", "{}")


def test_store_buffers_writes(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Config(ratio=2), files_per_run=1, flush_every=10)
    for k in range(6):
        store.write(spark.createDataFrame([(10 * k + j, 4 * k + j, j == 0, k) for j in range(4)], LOG))
        assert [r.level for r in store.manifest().runs].count(0) == (k + 1) % 3  # every third one fills the buffer
    assert store.level_pairs() == {1: 18}
    store.write(spark.createDataFrame([(99, 1, False, 7)], LOG))
    assert store.level_pairs() == {0: 1, 1: 18} and store.get(1) == 7
    store.flush()
    assert store.level_pairs() == {1: 19} and store.get(1) == 7


def test_store_readers_keep_what_they_opened(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Config(ratio=2), files_per_run=1, flush_every=1)
    for k in range(4):
        store.write(spark.createDataFrame([(k, k, False, k)], LOG))
    opened = store.state()
    store.write(spark.createDataFrame([(9, 9, False, 9)], LOG))  # merges what `opened` reads
    assert rows(opened, "key", "value") == [(k, k) for k in range(4)]


def test_stream_goes_on_where_it_was(spark, rows, tmp_path):
    ops = [(k % 6, k % 4 == 0, k) for k in range(40)]
    df, schema, root = log(spark, ops), LOG, str(tmp_path / "state")
    df.where("seq >= 20").write.parquet(str(tmp_path / "in"), mode="append")
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert rows(stream_latest(source, root), "key", "is_delete", "value") == rows(oplog.latest(df.where("seq >= 20")), "key", "is_delete", "value")
    df.where("seq < 20 or seq = 39").write.parquet(str(tmp_path / "in"), mode="append")  # late and repeated rows
    assert rows(stream_latest(source, root), "key", "is_delete", "value") == rows(oplog.latest(df), "key", "is_delete", "value")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinals_with_far_keys(spark, rows):
    """One key far off does not gather the others into one bucket."""
    from tideline.operators.ordinals import with_ordinal

    df = spark.range(50_000).select(F.col("id").alias("key")).union(spark.range(1).select(F.lit(1 << 60).alias("key"))).repartition(3)
    found = with_ordinal(df, [], "key")
    assert found.where("key < 50000 and ord <> key").count() == 0 and rows(found.where("ord = 50000"), "key") == [(1 << 60,)]
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in shown
    bounds = df.agg(F.percentile_approx("key", [k / 2048 for k in range(1, 2048)], 10_240)).first()[0]
    assert len(set(bounds)) > 1_500


def test_asof_ranges_meet_keys_not_the_log(spark):
    """Requests join distinct keys; operations meet a request's key only."""
    from tideline.operators import reads

    ops = log(spark, [(k % 9, k % 5 == 0, k) for k in range(200)])
    asked = spark.createDataFrame([(0, 50, 2, 7), (1, 199, 0, 9), (2, -1, 0, 9)], "ticket long, seq long, lo int, hi int")
    got = sorted((r["ticket"], r["key"], r["value"]) for r in reads.asof_range(ops, asked, block=16).collect())
    want = []
    for ticket, until, lo, hi in ((0, 50, 2, 7), (1, 199, 0, 9)):
        state = model([(k % 9, k % 5 == 0, k) for k in range(until + 1)])
        want += [(ticket, k, v) for k, v in state.items() if v is not None and lo <= k < hi]
    assert got == sorted(want)


def test_key_bounds_reach_the_scan(spark, tmp_path):
    log(spark, [(k, False, k) for k in range(100)]).write.parquet(str(tmp_path / "log"))
    from tideline.operators import reads

    df = spark.read.schema(LOG).parquet(str(tmp_path / "log"))
    shown = plan(reads.range_scan(df, 10, 20))
    assert "GreaterThanOrEqual(key,10)" in shown and "LessThan(key,20)" in shown
    assert "EqualTo(key,7)" in plan(reads.point_get(df, 7))
    state = plan(oplog.state(df))
    assert "SortAggregate" not in state and "Python" not in state and state.count("Exchange") == 1
    narrow = plan(oplog.tombstones(df))
    assert "ReadSchema: struct<seq:bigint,key:int,is_delete:boolean>" in narrow
