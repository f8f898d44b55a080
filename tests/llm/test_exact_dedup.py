import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from oracle import assert_same
from tideline.llm.common import scratch
from tideline.llm.exact_dedup import exact_dedup, sha256
from tideline.llm.queries import ORACLE_SQL, op9_exact_dedup

DOCS = [(3, "a b"), (1, "a  b"), (2, "a\t\nb"), (5, None), (4, ""), (6, " "), (7, "a b "), (9, "A b"), (8, "x" * 50_000), (10, "x" * 50_000), (11, "a b"), (12, "dup"), (12, "dup"), (None, "dup"), (None, "alone")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute(docs):
    groups = {}
    for k, (i, t) in enumerate(docs):
        groups.setdefault(norm(t), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def decisions(found):
    rows = found.decisions.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_matches_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    assert decisions(exact_dedup(df)) == brute(DOCS)


def test_colliding_digests_drop_nothing(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = exact_dedup(df, digest=lambda t: F.substring(sha256(t), 1, 0))  # one digest for all
    assert sorted((r[:4] for r in decisions(found)), key=str) == sorted((r[:4] for r in brute(DOCS)), key=str)


def test_survivors_keep_columns_that_clash(spark, rows):
    df = spark.createDataFrame([(k, i, t, "k", 7) for k, (i, t) in enumerate(DOCS)], "digest int, doc_id long, text string, kept string, row int").withColumns({c: F.lit(1) for c in ("_maybe", "_bucket", "_place", "file", "norm", "first")})
    kept = exact_dedup(df).survivors()
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in brute(DOCS) if r[3]), key=str)
    assert {r["kept"] for r in kept.collect()} == {"k"}


def one_digest(text):
    return F.substring(sha256(text), 1, 0)


@pytest.mark.parametrize("digest", [sha256, one_digest])
def test_state_goes_on(spark, tmp_path, digest):
    """Three calls: each decides on its rows against all seen so far, and the
    history equals one run over the union."""
    root = str(tmp_path / "state")
    parts = [DOCS[:6], DOCS[6:9], [*DOCS[9:], (0, "a b"), (20, "dup"), (21, "new")]]
    seen = []
    for n, part in enumerate(parts):
        seen += part
        if n == 1:  # a call that reads its rows where they lie
            path = str(tmp_path / "in [a] place")
            spark.createDataFrame(part, "doc_id long, text string").write.parquet(path)
            df = spark.read.parquet("".join(f"\\{c}" if c in "[]" else c for c in path))
        else:
            df = spark.createDataFrame(part, "doc_id long, text string").repartition(2)
        found = exact_dedup(df, digest=digest, root=root)
        sizes, least = {}, {}
        for i, t in seen:
            sizes[norm(t)] = sizes.get(norm(t), 0) + 1
            if i is not None:
                least[norm(t)] = min(i, least.get(norm(t), i))
        got = found.decisions.select("doc_id", "keep_id", "group_size").collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(((i, least.get(norm(t)), sizes[norm(t)]) for i, t in part), key=str)
    history = found.history().select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted((tuple(r) for r in history), key=str) == sorted((r[:4] for r in brute(seen)), key=str)
    assert sum(r["kept"] for r in history) == len({norm(t) for _, t in seen})


def test_state_remembers_collisions(spark, tmp_path):
    root = str(tmp_path / "state")
    run = lambda *docs: sorted(tuple(r) for r in exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), digest=one_digest, root=root).decisions.select("doc_id", "keep_id", "group_size", "kept").collect())
    assert run((1, "a")) == [(1, 1, 1, True)]
    assert run((9, "b")) == [(9, 9, 1, True)]
    assert run((5, "a"), (0, "b")) == [(0, 0, 2, True), (5, 1, 2, False)]
    assert run((7, "a")) == [(7, 1, 3, False)]


def test_only_a_state_that_goes_on_has_checksums(spark, tmp_path):
    """A state of the call's own writes none, so its stores have no threads for
    them, which took an executor's memory at 211 partitions."""

    def checksums(root):
        return [f for _, _, names in os.walk(root) for f in names if f.endswith(".crc") and not f.startswith(".")]

    name = "spark.sql.streaming.checkpoint.fileChecksum.enabled"
    before = spark.conf.get(name)
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    with scratch(spark) as path:
        assert decisions(exact_dedup(df)) == brute(DOCS)
        assert not checksums(path.removeprefix("file://"))
    assert decisions(exact_dedup(df, root=str(tmp_path / "state"))) == brute(DOCS)
    assert bool(checksums(tmp_path)) == (before == "true")
    assert spark.conf.get(name) == before


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).decisions.count() == 0


def test_query(spark):
    assert_same(op9_exact_dedup(spark, SMALL), ORACLE_SQL["op9_exact_dedup"], SMALL)
