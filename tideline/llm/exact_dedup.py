"""Exact deduplication over a keyed streaming state.

A Structured Streaming query keeps one entry per content digest in a disk-backed
(RocksDB) state store that never expires: the digest, the smallest stable
identifier seen with that row's content locator, the locator of the first row
taken in (the anchor), and the number of rows. Every later row of a digest is a
hit, and its full bytes are compared with those behind the anchor's locator, so a
digest collision cannot drop a document.

The state goes on: calls with the same ``root`` append to one log, and the stream
takes in what is new. An anchor never changes, so a hit is compared with the bytes
of a row that an earlier call has taken in, read again from its file. Digests
behind which texts differ are remembered, and their rows are told apart by bytes.

Only DataFrame operations run on the executors. What moves is small: the digest
log (no texts) goes through the stream; texts move only for rows that share a
digest, chosen by a bitmap of fixed size, and meet their anchor in an equi-join
whose hot partitions adaptive execution splits.

Defined results: a null text counts as the empty text; of equal texts the row
with the smallest id stays, and of rows that repeat that id, the one that comes
first by file and position; a null id ranks after all others; an empty table
gives an empty result; further columns are carried by ``survivors`` and may have
any name that does not start with ``_tideline_``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, KeyFilter, names_in, new_path, with_place, write_shared

#: A run of ASCII white space other than one single space; replacing only these gives the same text and touches less.
_ODD_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A store per partition: no disk is set aside for each before it is needed.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: For a state that ends with its call. Checksums of checkpoint files take four threads a store, with stacks and malloc arenas of their own.
_OWN = {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ODD_RUN, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _state_schema(id_type: str) -> str:
    return f"digest binary, first struct<no_id: boolean, doc_id: {id_type}, file: string, row: bigint>, anchor struct<call: int, file: string, row: bigint>, group_size bigint"


def _run_stream(spark: SparkSession, log_schema, root: str, own: bool = False) -> int:
    """Take in what is new in the log under ``root``. Returns the number of the
    last batch before this call; later ones have the entries that it touched.
    ``own``: no later call goes on with the state."""
    done = [int(x) for x in names_in(spark, f"{root}/checkpoint/commits") if x.isdigit()]
    state = (
        spark.readStream.schema(log_schema)
        .parquet(f"{root}/log")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first"),
            F.min(F.struct("call", "file", "row")).alias("anchor"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    settings = _ROCKSDB | (_OWN if own else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return max(done, default=-1)


def read_state(spark: SparkSession, root: str, id_type: str = "bigint", after: int = -1) -> DataFrame:
    """``digest, first, anchor, group_size``: the newest entries of the state under
    ``root``, of all digests or of those that batches after ``after`` touched."""
    schema = _state_schema(id_type)
    batches = [x for x in names_in(spark, f"{root}/changes") if x.startswith("batch=") and int(x[6:]) > after]
    if not batches:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, batch int").option("basePath", f"{root}/changes").parquet(*(f"{root}/changes/{b}" for b in batches))
    if len(batches) == 1:
        return found.drop("batch")
    return found.groupBy("digest").agg(*(F.max_by(c, "batch").alias(c) for c in ("first", "anchor", "group_size")))


def fetch(spark: SparkSession, places: DataFrame, text_col: str) -> DataFrame:
    """``places (file, row, ...)`` with ``norm``, the normalised text that stands
    there. The files are listed by name, as for any scan; only their rows in
    ``places`` pass the join."""
    files = [r[0] for r in places.select("file").distinct().collect()]
    if not files:
        return places.withColumn("norm", F.lit(None).cast("string"))
    # Locators are URIs, and readers take patterns.
    named = ["".join(f"\\{c}" if c in "[]{}*?\\" else c for c in unquote(f)) for f in files]
    held = spark.read.schema(f"`{text_col}` string").parquet(*named)
    place = held.metadataColumn("_metadata")
    held = held.select(place.getField("file_path").alias("file"), place.getField("row_index").alias("row"), normalised(F.col(text_col)).alias("norm"))
    return held.join(places, ["file", "row"])


@dataclass(frozen=True)
class ExactDedup:
    """Of a call's rows: ``decisions``, a row per input row (doc_id, keep_id,
    group_size, kept, digest, file, row), against all that the state has seen, and
    ``survivors``: the kept rows of the input as they were. ``history``: decisions
    on all rows of all calls so far, for an id that comes later may be smaller."""

    decisions: DataFrame
    survivors: Callable[[], DataFrame]
    history: Callable[[], DataFrame]


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    root: str | None = None,
    filter_bits: int = 26,
) -> ExactDedup:
    """Deduplicate ``docs`` by whole normalised text.

    ``digest`` maps the normalised text to the binary state key. A weak one is
    slow and still right: texts that differ behind one digest are told apart by
    their bytes. ``root`` names the folder of the streaming state (one of its
    own by default). With the same ``root``, ids, texts and digest must be of the
    same kind, the files of earlier calls must still be there, each call's rows
    count as new ones, and one call runs at a time.
    """
    spark = docs.sparkSession
    columns = docs.columns
    own = not root
    root = (root or new_path(spark, "dedup-state")).rstrip("/")
    call = 1 + max((int(x[5:]) for x in names_in(spark, f"{root}/log") if x.startswith("call=")), default=-1)
    placed = with_place(docs, f"{root}/documents/call={call}")
    norm = normalised(F.col(text_col))
    taken = placed.select(F.col(id_col).alias("doc_id"), digest(norm).alias("digest"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    taken.write.parquet(f"{root}/log/call={call}")
    id_type = taken.schema["doc_id"].dataType.simpleString()
    log_schema = f"doc_id {id_type}, digest binary, file string, row bigint"
    taken = spark.read.schema(log_schema).parquet(f"{root}/log/call={call}")
    last = _run_stream(spark, f"{log_schema}, call int", root, own)
    state = read_state(spark, root, id_type, last)

    # Full bytes of the hits: only rows whose digest may be a repeated one are read for their text again.
    repeated = state.where("group_size > 1").select("digest", "anchor")
    maybe = KeyFilter.of(repeated, F.col("digest"), filter_bits)
    marked = maybe.split(placed.withColumn("_tideline_norm", norm).withColumn("_tideline_digest", digest(F.col("_tideline_norm"))), F.col("_tideline_digest"))
    candidates = write_shared(marked.where("_tideline_maybe").drop("_tideline_maybe"), "dedup-candidates")
    texts = candidates.select(F.col("_tideline_digest").alias("digest"), F.col(FILE).alias("file"), F.col(ROW).alias("row"), F.col("_tideline_norm").alias("norm"))
    anchors = repeated.select("digest", "anchor.*")
    known = texts.join(anchors.where(F.col("call") == call).select("file", "row"), ["file", "row"], "left_semi").select("digest", F.col("norm").alias("kept_norm"))
    if call:
        earlier = write_shared(anchors.where(F.col("call") < call).drop("call"), "dedup-anchors")
        known = known.unionByName(fetch(spark, earlier, text_col).select("digest", F.col("norm").alias("kept_norm")))
    # Not made distinct before it is written: an aggregate on the join's key would keep a hot digest in one task.
    differs = texts.join(known, "digest").where("norm <> kept_norm").select("digest")
    differs.write.parquet(f"{root}/collided/call={call}")
    collided = spark.read.schema("digest binary").option("recursiveFileLookup", "true").parquet(f"{root}/collided").distinct()

    def every() -> DataFrame:
        return spark.read.schema(f"{log_schema}, call int").option("basePath", f"{root}/log").parquet(f"{root}/log")

    decisions = _decide(taken, state)
    if not collided.isEmpty():
        decisions = _by_bytes(decisions, taken, every(), collided, text_col)

    def history() -> DataFrame:
        found = _decide(every(), read_state(spark, root, id_type))
        return found if collided.isEmpty() else _by_bytes(found, every(), every(), collided, text_col)

    def survivors() -> DataFrame:
        clear = marked.where(~F.col("_tideline_maybe")).select(*columns)
        kept = decisions.where("kept").select(F.col("file").alias(FILE), F.col("row").alias(ROW))
        return clear.unionByName(candidates.join(kept, [FILE, ROW], "left_semi").select(*columns))

    return ExactDedup(decisions, survivors, history)


def _decide(rows: DataFrame, state: DataFrame) -> DataFrame:
    return rows.join(state, "digest", "left").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
        "digest",
        "file",
        "row",
    )


def _by_bytes(decisions: DataFrame, rows: DataFrame, every: DataFrame, collided: DataFrame, text_col: str) -> DataFrame:
    """``decisions`` on ``rows`` anew for the digests behind which texts differ:
    all rows of these (``every``) are grouped by the bytes themselves, with partial
    aggregation before the shuffle."""
    spark = rows.sparkSession
    affected = every.join(collided, "digest", "left_semi").select("doc_id", "digest", "file", "row")
    texts = write_shared(fetch(spark, write_shared(affected, "dedup-affected"), text_col), "dedup-texts")
    groups = texts.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    of = texts.join(rows.select("file", "row"), ["file", "row"], "left_semi")
    again = of.join(groups.withColumnRenamed("digest", "_digest").withColumnRenamed("norm", "_norm"), (F.col("digest") == F.col("_digest")) & (F.col("norm") == F.col("_norm")))
    again = again.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
        "digest",
        "file",
        "row",
    )
    return decisions.join(collided, "digest", "left_anti").select(*again.columns).unionByName(again)
