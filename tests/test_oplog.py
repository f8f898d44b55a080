"""Reads against a model: a dict that takes the operations in order."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.operators import oplog, reads, runs
from tideline.operators.ordinals import with_ordinal

LOG = "seq long, key int, is_delete boolean, value int"
operations = st.lists(st.tuples(st.integers(-3, 6), st.booleans(), st.integers(-9, 9)), max_size=40)
slow = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def log(spark, ops):
    return spark.createDataFrame([(k, key, delete, None if delete else value) for k, (key, delete, value) in enumerate(ops)], LOG)


def model(ops):
    state = {}
    for key, delete, value in ops:
        state[key] = None if delete else value
    return state


@slow
@given(operations)
def test_state_and_tombstones(spark, rows, ops):
    want, df = model(ops), log(spark, ops)
    assert rows(oplog.state(df), "key", "value") == sorted((k, v) for k, v in want.items() if v is not None)
    assert rows(oplog.tombstones(df)) == sorted((k,) for k, v in want.items() if v is None)


@slow
@given(operations, st.integers(1, 7), st.integers(2, 3))
def test_layout_does_not_change_the_state(spark, rows, ops, flush_every, ratio):
    df = log(spark, ops)
    held = runs.contents(df, flush_every, ratio)
    newest = runs.merged(held.selectExpr("key", "is_delete", "value", "run - level * 1099511627776 as run_id"))
    assert rows(oplog.live(newest), "key", "value") == rows(oplog.state(df), "key", "value")
    assert rows(runs.shadowed_out(runs.flushed(df, flush_every)), "key", "is_delete", "value") == rows(oplog.latest(df), "key", "is_delete", "value")


@slow
@given(operations, st.lists(st.tuples(st.integers(-1, 41), st.integers(-4, 7)), max_size=12), st.sampled_from([1, 3, 1 << 20]))
def test_asof_get(spark, ops, gets, block):
    asked = spark.createDataFrame([(t, s, k) for t, (s, k) in enumerate(gets)], "ticket long, seq long, key int")
    found = {r["ticket"]: (r["status"], r["output"]) for r in reads.asof_get(log(spark, ops), asked, block).collect()}
    for t, (s, k) in enumerate(gets):
        seen = model(ops[: s + 1])
        want = ("MISSING", "") if k not in seen else ("DELETED", "") if seen[k] is None else ("FOUND", str(seen[k]))
        assert found[t] == want


@slow
@given(operations, st.lists(st.tuples(st.integers(-1, 41), st.integers(-5, 8), st.integers(-5, 8)), max_size=8))
def test_ranges(spark, rows, ops, ranges):
    asked = spark.createDataFrame([(t, *r) for t, r in enumerate(ranges)], "ticket long, seq long, lo int, hi int")
    df = log(spark, ops)

    def want(seen):
        return sorted((t, n, k, v) for t, (s, lo, hi) in enumerate(ranges) for n, (k, v) in enumerate(sorted((k, v) for k, v in seen(s).items() if v is not None and lo <= k < hi)))

    assert rows(reads.multi_range(df, asked), "ticket", "ord", "key", "value") == want(lambda s: model(ops))
    assert rows(reads.asof_range(df, asked), "ticket", "ord", "key", "value") == want(lambda s: model(ops[: s + 1]))
    counts = {t: 0 for t in range(len(ranges))}
    for t, *_ in want(lambda s: model(ops)):
        counts[t] += 1
    assert {r["ticket"]: r["n"] for r in reads.range_counts(df, asked).collect()} == counts


def test_ranges_of_all_widths(spark, rows):
    rng = random.Random(5)
    keys = sorted({rng.randrange(-(1 << 31), 1 << 31) for _ in range(300)} | {-(1 << 31), (1 << 31) - 1})
    df = log(spark, [(k, False, 1) for k in keys])
    ranges = []
    for t in range(60):
        lo = rng.choice(keys)
        ranges.append((t, lo, min((1 << 31) - 1, lo + (1 << rng.randrange(0, 32)))))
    asked = spark.createDataFrame(ranges, "ticket long, lo int, hi int")
    want = sorted((t, k) for t, lo, hi in ranges for k in keys if lo <= k < hi)
    assert rows(reads.multi_range(df, asked), "ticket", "key") == want


def test_nulls_and_empty(spark, rows):
    df = spark.createDataFrame([(0, None, False, 1), (1, 5, False, None), (2, 6, None, 3)], LOG)
    ops = oplog.as_log(df, df.seq, df.key, df.is_delete, df.value)
    assert rows(oplog.state(ops), "key", "value") == [(5, None), (6, 3)]
    empty = ops.where("false")
    asked = spark.createDataFrame([(0, 5), (1, None)], "ticket long, key int")
    assert rows(reads.multi_get(empty, asked), "ticket", "status") == [(0, "MISSING"), (1, "MISSING")]
    assert rows(reads.multi_get(ops, asked), "ticket", "status", "output") == [(0, "FOUND", ""), (1, "MISSING", "")]
    assert oplog.state(empty).count() == 0 and runs.contents(empty, 3, 2).count() == 0
    assert [tuple(r) for r in reads.point_get(empty, 4).collect()] == [(4, "MISSING", "")]


def test_ordinal_of_one_key_and_groups(spark, rows):
    df = spark.createDataFrame([(g, k) for g in ("a", "b", None) for k in (7, -2, 7_000_000)], "g string, k long")
    found = rows(with_ordinal(df, ["g"], "k"), "g", "ord", "k")
    assert found == sorted(((g, n, k) for g in ("a", "b", None) for n, k in enumerate((-2, 7, 7_000_000))), key=lambda r: (r[0] is None, str(r[0]), r[1]))


def simulate(flushes, ratio):
    """Levels as lists of runs, each a list of flushes."""
    levels = []
    cap = lambda k: ratio * 2 if k == 0 else ratio
    for f in range(flushes):
        full = 0
        while full < len(levels) and len(levels[full]) >= cap(full):
            full += 1
        for k in range(full, 0, -1):
            while len(levels) <= k:
                levels.append([])
            levels[k].append([x for run in levels[k - 1] for x in run])
            levels[k - 1] = []
        if not levels:
            levels.append([])
        levels[0].append([f])
    return levels


@pytest.mark.parametrize("ratio", [2, 3, 4])
def test_layout_is_the_cascade(ratio):
    for n in range(0, 130):
        want = simulate(n, ratio)
        got = runs.layout(n, ratio)
        assert [x.runs for x in got] == [len(level) for level in want]
        for x, level in zip(got, want, strict=True):
            assert [f for run in level for f in run] == list(range(x.first, x.last))
