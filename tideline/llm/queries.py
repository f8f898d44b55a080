"""The registered queries of the training-data operators, and their DuckDB SQL.

Each query applies its operator to the whole table with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import examples, format_chat, read_turns, unescape
from .common import id_crc32, small_batches, write_shared
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .html_extraction import extract
from .langid import fit_languages, identify_languages
from .license_scan import scan_licenses
from .lm_scoring import score_texts
from .packing import pack_documents
from .simhash import hex_fp, simhash_components
from .toxicity import fit_toxicity, label_categories, score_toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_texts(docs, id_crc32() % 10 != 0)
    return found.withColumn("held_out", ~F.col("learnt")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: Texts that look like the template's own marks.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    stored = format_chat(table(spark, sf_dir, "conversations").select(own.columns).unionByName(own))
    loss = unescape(F.substr("text", F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))
    replies = examples(stored).select("conv_id", F.struct("example", loss.alias("loss")).alias("x"), F.length("text").cast("long").alias("chars"))
    told = replies.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["loss"]), "").alias("loss"),
        F.count(F.lit(1)).alias("n"),
        F.sum("chars").alias("chars"),
    )
    read = stored.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("read"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    loss = F.coalesce("loss", F.lit(""))
    return whole.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_examples"),
        F.coalesce("chars", F.lit(0).cast("long")).alias("example_chars"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_toxicity(docs, table(spark, sf_dir, "labels"), label_categories())
    with small_batches(spark):
        return write_shared(score_toxicity(docs, chain).drop("text"), "toxicity-scores")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc32() % 3 == 1
    model = fit_languages(docs, ~held_out)
    found = identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents")).decisions
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fp().alias("fingerprint"), "component_id")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_license_scan": op2_license_scan,
    "op3_html_extraction": op3_html_extraction,
    "op5_chat": op5_chat,
    "op7_language_id": op7_language_id,
    "op4_packing": op4_packing,
    "op6_toxicity": op6_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL = {
    "op5_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
             t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                          5 + length(CASE WHEN role IN ('user', 'assistant', 'system') THEN role
                                     ELSE '=' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ': ', ':\ ') END)
                          + 2 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS chars
                   FROM c),
             s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars,
               count(*) FILTER (role = 'assistant') AS n_examples,
               CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
        FROM s GROUP BY conv_id""",
    "op8_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bp AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0),
             iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM bp),
             lens AS (SELECT DISTINCT n FROM iw),
             dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN lens ON len(w) >= n),
             dg AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
             hits AS (SELECT r, p, n, item_id FROM dg JOIN iw USING (n, g)),
             cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
             ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
                     FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (r) LEFT JOIN ids USING (r)""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
}
