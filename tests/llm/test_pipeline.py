"""The stages on a small table, each against what it must do with its own input."""

import os
import re

import corpus_pipeline
from conftest import SMALL
from tideline.llm.common import KeyFilter, scratch, without_keys, write_shared
from tideline.sources.shared import shared_dir
from tideline.llm.queries import op6_toxicity, table
from test_decontam import brute as leaks
from test_simhash import brute as near
from pyspark.sql import functions as F


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    at = {"documents": docs}
    last = "documents"
    for name, stage in corpus_pipeline.STAGES:
        at[name] = write_shared(stage(spark, at[last], SMALL), name)
        last = name
        if name != "packing":
            assert at[name].columns == columns
    ids = {k: sorted(r["doc_id"] for r in v.select("doc_id").distinct().collect()) for k, v in at.items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in op6_toxicity(spark, SMALL).where("toxic").collect()}
    assert ids["toxicity"] == sorted(set(texts) - toxic)
    first = {}
    for i in ids["toxicity"]:
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", texts[i] or ""), i)
    assert ids["exact_dedup"] == sorted(first.values())
    assert ids["near_dedup"] == sorted(i for i, _, c in near([(i, texts[i]) for i in ids["exact_dedup"]]) if i == c)
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    assert ids["decontamination"] == sorted(r[0] for r in leaks([(i, texts[i]) for i in ids["near_dedup"]], items) if not r[5])
    assert ids["packing"] == ids["decontamination"]
    assert corpus_pipeline.run(spark, SMALL).count() == at["packing"].count()


def test_nothing_is_left_behind(spark, tmp_path):
    """With the output written, the shared folder has no intermediate tables, and
    the session its settings."""
    root, name = shared_dir(spark).removeprefix("file://") + "/tideline", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, setting = set(os.listdir(root)) if os.path.exists(root) else set(), spark.conf.get(name)
    with scratch(spark):
        corpus_pipeline.run(spark, SMALL).write.parquet(str(tmp_path / "out"))
    assert set(os.listdir(root)) == before and spark.conf.get(name) == setting
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_key_filter_never_misses(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    gone = df.where("doc_id % 7 = 0")
    for bits in (15, 16, 20):
        marked = KeyFilter.of(gone, F.col("doc_id"), bits).split(df, F.col("doc_id"))
        assert marked.where("doc_id % 7 = 0 and not _tideline_maybe").count() == 0
        kept = without_keys(df.withColumn("_x", F.lit(1)), gone, "doc_id", bits=bits)
        assert kept.count() == df.count() - gone.count() and kept.where("doc_id % 7 = 0").count() == 0
