"""The corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark
contamination, packing.

Each stage takes the documents that its predecessor kept, as a table, and its
decisions take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import new_path, scratch
from tideline.llm.decontam import drop_contaminated
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.packing import pack_documents
from tideline.llm.queries import table, tokenizer_path
from tideline.llm.simhash import drop_near_duplicates
from tideline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact_dedup(docs).survivors()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with ``benchmark``."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the fitted chain, the fingerprints or the plan of sequences.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again. A
    stage's intermediate tables go when its output is written; the outputs
    themselves, which the result needs, when the driver ends or ``scratch`` does."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark, name):
            found = stage(spark, docs, sf_dir)
            found.write.mode("append").parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
