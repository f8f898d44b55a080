import gc
import itertools
import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructField

from tideline.llm.packing import WordTokenizer, best_fit, enumerate_patterns, make_plan, pack, pack_documents, pieces
from tideline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["", " ", "a", "Hello, World! it's 42 dogs'", "don't ÉtÉ naïve K", "İstanbul ß ﬁ", "á é́", "x" * 5000, "\U0001f600\U0001f468‍\U0001f469", "a\x1cb\x1fc", " a b　c", "<|endoftext|> <|startoftext|>", "a.b.c...!?", "中文 ไทย", "tab\tnew\nline\r\n", "\x00\x01", "1234567890 ١٢", "'s 't ''s", "word--word", "​﻿"]


def test_ids_are_the_tokenizers():
    rng = random.Random(8)
    alphabet = "abcXYZ éÉİß0123'\".,!-\n\t \x1d中\U0001f600́<|>"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    for size in (7, 10_000):
        tokenizer = WordTokenizer(PATH, cache_words=50 if size == 7 else 10_000)
        got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), size) for x in tokenizer.ids(pa.array(texts[at : at + size]))]
        assert got == [whole_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_of_documents(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["dog", "house", "supercalifragilistic"]) for _ in range(rng.choice([0, 3, 40, 500, 2500])))) for k in range(300)]
    docs += [(900, None), (901, "dog " * 2047), (902, "dog " * 2048), (903, "dog " * 6143), (5, docs[5][1]), (None, "dog")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(4)
    found = pack_documents(df, PATH).collect()
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append([*whole_tokenizer().encode(t or "", add_special_tokens=False).ids, 0])
    want = sorted((i, p, p * 2048, len(x[p * 2048 :][:2048]), zlib.crc32(np.array(x[p * 2048 :][:2048], "<u4").tobytes())) for i, xs in ids.items() if i is not None for x in xs for p in range(-(-len(x) // 2048)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] is not None) == want
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    lower = max(sum(r["length"] for r in found) / 2048, sum(r["length"] > 1024 for r in found))  # no two long ones share a sequence
    assert len(places) <= 1.03 * lower + 1


def test_workers_give_memory_back():
    """A worker outlives its task: Arrow's pool then holds no unused memory."""

    class Docs:
        schema = {"doc_id": StructField("doc_id", LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    def anonymous():
        gc.collect()
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024

    def batches():
        rng = random.Random(5)
        for k in range(4):
            texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(600)) for _ in range(1000)]
            yield pa.RecordBatch.from_arrays([pa.array(range(1000 * k, 1000 * k + 1000)), pa.array(texts)], names=["doc_id", "text"])

    assert sum(b.num_rows for b in pieces(Docs(), tokenizer_path("word_bpe_49k.json"))(batches())) >= 4000
    held = anonymous()
    pa.default_memory_pool().release_unused()
    assert held - anonymous() < 8


def test_hot_lengths_are_salted(spark):
    df = spark.createDataFrame([(k, 0, 1 if k % 3 == 0 else 700 + k % 5) for k in range(3000)], "doc_id long, piece int, length long")
    found = pack(df, rows_per_salt=10).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 3000
    assert len(found) == 3000


def test_rows_without_ids_are_salted(spark):
    """One id, or none, and one length for all rows: salts part them all the same."""
    df = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "0 as piece", "cast(700 as bigint) as length")
    found = pack(df, rows_per_salt=10).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 3000 and len({r["sequence_id"] for r in found}) == 1500


def test_other_vocabularies_are_used_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 1, "?": 0}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    other.save(str(tmp_path / "t.json"))
    tokenizer = WordTokenizer(str(tmp_path / "t.json"))
    assert not tokenizer.by_word and WordTokenizer(PATH).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.ids(pa.array(["a b|a b", "x"]))] == [[1, 1], [0]]


def test_patterns_are_all_enumerated():
    present = [1, 2, 3, 5, 8, 13, 17, 20]
    want = {tuple(sorted(p, reverse=True)) + (0,) * (3 - len(p)) for n in (1, 2, 3) for p in itertools.combinations_with_replacement(present, n) if sum(p) == 20}
    got = [tuple(int(v) for v in p) for p in enumerate_patterns(np.array(present), 20)]
    assert set(got) == want and len(got) == len(want)
    assert len(enumerate_patterns(np.arange(1, 2049), 2048)) == 1 + 1024 + 349_525


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(2049, np.int64)
    lengths = np.clip(rng.lognormal(5 + seed / 3, 1, 3000).astype(int), 1, 2048)
    np.add.at(histogram, lengths, rng.integers(1, 50, 3000))
    plan = make_plan(histogram)
    used = np.zeros(2049, np.int64)
    for n, parts in plan.groups:
        assert n > 0 and sum(parts) <= 2048
        for v in parts:
            used[v] += n
    assert (used == histogram).all()
    lower = -(-int((histogram * np.arange(2049)).sum()) // 2048)
    assert lower <= plan.sequences <= 1.02 * lower + 1
    assert plan.bound == lower and plan.sequences <= sum(n for n, _ in best_fit(histogram, 2048))
    assert plan.share > 0 or plan.sequences < make_plan(histogram, shares=(1.0, 0.75, 0.5, 0.25)).sequences  # best-fit alone only where it is better
