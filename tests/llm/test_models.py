"""Toxicity, language identification and text scores: held-out accuracy, exact
counts, and sums of probabilities."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid, lm_scoring, toxicity
from tideline.llm.common import id_crc32, slices

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.execute(f"SELECT DISTINCT doc_id, text, quality, toxic FROM '{DATA}/documents.parquet' JOIN '{DATA}/labels.parquet' USING (doc_id) ORDER BY 1").fetchall()
    y = np.array([[np.nan if q is None else 1 - q, np.nan if t is None else t] for _, _, q, t in rows], float)
    return [r[1] for r in rows], [toxicity.present([r[1]])[1] for r in rows], y


def test_toxicity_held_out(labelled):
    texts, found, y = labelled
    learn = np.arange(len(texts)) % 2 == 0
    chain = toxicity.train_chain([found[k] for k in np.flatnonzero(learn)], y[learn], ["low_quality", "toxic"])
    p = chain.score([texts[k] for k in np.flatnonzero(~learn)])
    said, truth = p[:, 1] >= chain.thresholds[1], y[~learn][:, 1] == 1
    assert (said & truth).sum() >= 0.9 * truth.sum()  # recall
    assert (said & ~truth).sum() <= 0.01 * (~truth).sum()  # clean documents stay
    assert chain.models[1].chain.shape == (1,) and p.min() >= 0 and p.max() <= 1


def test_toxicity_edge_cases(spark, rows):
    docs = spark.createDataFrame([(k, "you idiot" if k % 2 else "fine day", "p") for k in range(60)] + [(None, None, "p"), (70, "", "p"), (71, "z" * 200_000, "p")], "doc_id long, text string, p_toxic2 string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(61, None, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, toxicity.label_categories()))
    toxic = {r["doc_id"]: r["toxic"] for r in found.collect()}
    assert all(toxic[k] == bool(k % 2) for k in range(60)) and not toxic[None] and not toxic[70] and not toxic[71]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 33
    often = docs.where("doc_id = 1").crossJoin(spark.range(5000)).drop("id")
    assert toxicity.fit_toxicity(docs.unionByName(often), labels, toxicity.label_categories()).thresholds == toxicity.fit_toxicity(docs, labels, toxicity.label_categories()).thresholds
    none = labels.where("false")
    assert toxicity.drop_toxic(docs, none).count() == docs.count()  # nothing learned, nothing rejected
    assert toxicity.drop_toxic(docs.where("false"), labels).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = id_crc32() % 3 == 1
    model = langid.fit_languages(docs, ~held)
    found = langid.identify_languages(docs.where(held).select("doc_id", "text", F.col("lang").alias("score2")), model)
    right, n = found.where("score2 is not null").agg(F.sum((F.col("score2") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.99 * n
    low, high = found.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low and high <= 1


def test_languages_edge_cases(spark):
    texts = ["the cat sat on the mat", "der Hund liegt auf der Matte"]
    docs = spark.createDataFrame([(k, texts[k % 2], ["en", "de"][k % 2]) for k in range(80)] + [(90, None, "en"), (91, "123 !", "en"), (92, "", None), (93, "the cat " * 30_000, None), (None, "der Hund", None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, F.col("doc_id") % 4 < 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in langid.identify_languages(docs.select("doc_id", "text"), model).collect()}
    assert all(got[k][0] == ["en", "de"][k % 2] for k in range(80)) and got[93][0] == "en" and got[None][0] == "de"
    assert all(got[k] == ("und", 0.0, False) for k in (90, 91, 92))
    empty = langid.fit_languages(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify_languages(docs.select("doc_id", "text"), empty).collect()} == {"und"}
    assert langid.identify_languages(docs.where("false"), model).count() == 0


def test_letters_are_of_category_l():
    assert langid.letters("½ ² Ⅷ ① 〇 _ 5 ٣") == []
    assert langid.letters("Ab½c x² _Ÿ_ 中文 ª") == ["ab", "c", "x", "ÿ", "中文", "ª"]


def test_rare_languages_are_learned():
    rates = langid._rates({"a": 1_000_000, "b": 10, "c": 5_000}, 3000)
    assert rates["b"] == 1 and sum(n * rates[k] for k, n in {"a": 1_000_000, "b": 10, "c": 5_000}.items()) == pytest.approx(3000)
    assert rates["a"] * 1_000_000 == pytest.approx(1495) and rates["c"] * 5_000 == pytest.approx(1495)


def test_columns_of_the_results_replace_others(spark):
    docs = spark.createDataFrame([(1, "ein Hund", "x", True, "y"), (2, "½", "x", True, "y")], "doc_id long, text string, score string, accepted boolean, lang_pred string")
    model = langid.fit_languages(docs.withColumn("lang", F.lit("de")), F.lit(True))
    found = langid.identify_languages(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]
    assert [(r["lang_pred"], r["score"]) for r in found.orderBy("doc_id").collect()] == [("de", 1.0), ("und", 0.0)]
    chain = toxicity.train_chain([], np.zeros((0, 2)), ["low_quality", "toxic"])
    scored = toxicity.score_toxicity(docs.withColumn("toxic", F.lit("t")).withColumn("p_toxic", F.lit(7)), chain)
    assert scored.columns == [*docs.columns, "p_low_quality", "p_toxic", "toxic"] and not scored.where("toxic").count()


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", lower)


def test_words_of_slices():
    texts = [None, "", " \t", "A b\x0bÉ\x85é\u3000X\x1cy", " lead", "trail \n", "a" * 100, "x " * 50_000, None, "ÀÉ Z"]
    got = []
    column = pa.array(texts * 30)
    cuts = list(slices(column, 150_000, 7))
    assert max(n for _, n in cuts) <= 7 and [a + n for a, n in cuts] == [*(a for a, _ in cuts[1:]), 300] and list(slices(column[:0], 9)) == []
    for at, n in cuts:
        words, index, bounds = lm_scoring.split_words(column.slice(at, n))
        got += [[words[k].decode() for k in index[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [split(t) for t in texts * 30]


@pytest.mark.parametrize("common", [5, 100_000])
def test_text_scores_count_exactly(spark, common):
    data = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1 LIMIT 60").fetchall()
    data += [(9001, None), (9002, ""), (9003, "never seen words"), (9004, "The THE the x"), (9004, "The THE the x"), (None, "a b")]
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    counts, n = Counter(), 0
    for i, t in data:
        if learns(i):
            counts.update(split(t))
            n += 1
    total, v = sum(counts.values()) + n, len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (v + 1)))
    want = sorted((str(i), learns(i), len(split(t)) + 1, sum(w in counts for w in split(t)) + 1, total, round(sum(log(counts[w]) for w in split(t)) + log(n), 6)) for i, t in data)
    df = spark.createDataFrame([(*d, 0) for d in data], "doc_id long, text string, score int").repartition(3)
    found = lm_scoring.score_texts(df, id_crc32() % 10 != 0, common=common).collect()
    assert sorted((str(r["doc_id"]), r["learnt"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    if common > 5:  # else the network has five words of its own
        assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lm_scoring.score_texts(docs, id_crc32() % 10 != 0).where("not learnt").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (found[0] - found[1]) / found[2] > 0.02  # log10 of a token


@pytest.mark.parametrize("shortlist", [4, 1000])
def test_words_sum_to_one(spark, monkeypatch, shortlist):
    """All known words, the end, and one unknown word of each class, after the start of a text."""
    held = []

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 30) % 50) for _ in range(200)]
    known = sorted({w for t in texts for w in t.split()})
    unknown = {}
    for k in range(10_000):
        unknown.setdefault(lm_scoring.ending_class(b"new%d" % k, 8), f"new{k}")
    assert len(unknown) == 8
    single = [*known, *unknown.values()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1 - k, w) for k, w in enumerate(single)] + [(-1000, "")], "doc_id long, text string")
    once = lm_scoring.TextModel.__post_init__
    monkeypatch.setattr(lm_scoring.TextModel, "__post_init__", lambda self: (once(self), held.append(self))[0])
    found = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(df, F.col("doc_id") >= 0, shortlist=shortlist, classes=8).collect()}
    model = held[0]
    start = len(model.network.context) - 1
    total = 10 ** found[-1000]  # the end
    for k, w in enumerate(single):
        n = model.number.get(w.encode())
        o = model.output[n] if n else model.shortlist + 1 + lm_scoring.ending_class(w.encode(), 8)
        z = (model._far[start] + model._near[o]) @ model.network.out[0] + model.network.bias[0] - model.log_z[start, o]
        total += 10 ** (found[-1 - k] - z / np.log(10))
    assert total == pytest.approx(1, abs=1e-4)


def test_outputs_sum_to_one():
    rng = np.random.default_rng(0)
    unigram = np.full(20, 0.05)
    model = lm_scoring.LogBilinear.train(rng.integers(0, 21, (500, 2)), rng.integers(0, 20, 500), unigram, dim=4, epochs=1)
    z = model.normaliser(step=50)
    for f, h in ((0, 0), (20, 20), (3, 17)):
        scores = (model.context[f] @ model.far + model.context[h] @ model.near) @ model.out.T + model.bias
        assert np.exp(scores - z[f, h]).sum() == pytest.approx(1)


def test_text_scores_without_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = lm_scoring.score_texts(df, F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in found] == [(0, 0)] * 2
    assert lm_scoring.score_texts(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("shards", [1, 5])
def test_the_network_learns_from_every_token(spark, monkeypatch, shards):
    texts = ["a b c d", "", None, "x " * 100_000, "b a"] * 3
    df = spark.createDataFrame([(k // 2 if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    code = {b"a": 1, b"b": 2, b"c": 3, b"d": 4, b"x": 5}
    held = lm_scoring.shards_of(df, code.get, 6, shards).collect()
    got = Counter()
    for r in held:
        history, target = lm_scoring.examples_of(r["parts"])
        got.update(zip(*history.T.tolist(), target.tolist(), strict=True))
    want = Counter()
    for t in texts:
        o = [6, 6, *(code[w.encode()] for w in split(t)), 0]
        want.update(zip(o, o[1:], o[2:], strict=False))
    assert got == want and len(held) == len({r["shard"] for r in held}) <= shards


def test_averaged_passes_learn(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(20)]
    texts = [" ".join(words[(k + j) % 20] for j in range(60)) for k in rng.integers(0, 20, 400)]  # each word tells the next
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = (lm_scoring.score_texts(df, F.lit(True), shard_tokens=n).agg(F.sum("score")).first()[0] for n in (1_000_000, 4_000))
    base = lm_scoring.score_texts(df, F.lit(True)).agg(F.sum("base_score")).first()[0]
    assert one > 0.5 * base and many > 0.5 * base
