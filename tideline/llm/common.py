"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_path, names_in, new_path, scratch, write_shared

__all__ = ["delete_path", "names_in", "new_path", "scratch", "write_shared"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For bytes.translate: A-Z to a-z, everything else unchanged.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Around an action: texts go to Python workers a thousand rows at a time,
    where the session has Spark's default of ten thousand. With long texts a
    batch of those holds much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, where memory that Arrow no longer uses goes back to
    the system after each batch. Workers outlive their tasks, and Arrow's pool
    would hold the most that a batch took for as long."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return wrapped


FILE, ROW = "_tideline_file", "_tideline_row"


def _plans(docs: DataFrame) -> list:
    out, todo = [], [docs._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        out.append(plan)
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return out


def _as_stored(plan) -> bool:
    """Whether a node of the plan leaves rows and columns as its files have them."""
    if plan.nodeName() == "Project":
        return all(plan.projectList().apply(i).getClass().getSimpleName() == "AttributeReference" for i in range(plan.projectList().size()))
    return plan.nodeName() in ("LogicalRelation", "SubqueryAlias", "Filter")


def with_place(docs: DataFrame, store: str | None = None) -> DataFrame:
    """``docs`` with ``_tideline_file`` and ``_tideline_row``, which name a row's place
    in its Parquet file, so that rows are told apart whatever ids they have.

    No column of ``docs`` may have a name that starts with ``_tideline_``.

    A frame that is not a plain scan of files is written first: into the folder
    ``store``, or as an intermediate table.
    """
    if sum(p.nodeName() == "LogicalRelation" for p in _plans(docs)) != 1 or not all(map(_as_stored, _plans(docs))):
        if store is None:
            docs = write_shared(docs, "documents")
        else:
            docs.write.parquet(store)
            docs = docs.sparkSession.read.schema(docs.schema).parquet(store)
    place = docs.metadataColumn("_metadata")
    return docs.withColumns({FILE: place.getField("file_path"), ROW: place.getField("row_index")})


def slices(texts: pa.Array, most_bytes: int, most_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Starts and lengths of slices of a column of texts, of about ``most_bytes``
    and ``most_rows`` at most; a longer text is a slice of its own. So long texts
    that stand together are not looked at together."""
    start = held = k = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > start and (held + size > most_bytes or k - start == most_rows):
            yield start, k - start
            start, held = k, 0
        held += size
    if len(texts):
        yield start, k + 1 - start


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_crc32(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


@dataclass(frozen=True)
class KeyFilter:
    """A bitmap of hashed keys of fixed size, ``2 ** bits`` bits whatever the
    number of keys, so broadcasting it has a proven bound (8 MB at 26 bits).

    It answers "certainly not a key" or "maybe": users handle the maybes exactly.
    With many more keys than bits everything becomes a maybe, which costs time
    and never changes a result.
    """

    rows: DataFrame
    bits: int

    @staticmethod
    def of(keys: DataFrame, key: Column, bits: int = 26) -> KeyFilter:
        place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
        rows = (
            keys.select(place.alias("_tideline_place"))
            .groupBy(F.shiftright("_tideline_place", 15).alias("_tideline_bucket"))
            .agg(F.bitmap_construct_agg(F.expr("_tideline_place & 32767")).alias("_tideline_bitmap"))
        )
        return KeyFilter(rows, bits)

    def split(self, df: DataFrame, key: Column) -> DataFrame:
        """``df`` with a boolean column ``_tideline_maybe``."""
        place = F.pmod(F.xxhash64(key), F.lit(1 << self.bits))
        byte = F.conv(F.hex(F.expr("substring(_tideline_bitmap, cast((_tideline_place & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        maybe = F.coalesce(F.expr("0") < F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(_tideline_place & 7 as int))")), F.lit(False))
        return (
            df.withColumn("_tideline_place", place)
            .withColumn("_tideline_bucket", F.shiftright("_tideline_place", 15))
            .join(F.broadcast(self.rows), "_tideline_bucket", "left")
            .withColumn("_tideline_maybe", maybe)
            .drop("_tideline_bucket", "_tideline_place", "_tideline_bitmap")
        )


def without_keys(df: DataFrame, dropped: DataFrame, *keys: str, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose ``keys`` are not in ``dropped`` (columns ``keys``).

    Rows that the bitmap clears pass without a shuffle; only the maybes meet the
    dropped keys in an anti-join. Rows with a null among their keys stay.
    """
    key = F.struct(*keys)
    marked = KeyFilter.of(dropped, key, bits).split(df, key)
    clear = marked.where(~F.col("_tideline_maybe")).drop("_tideline_maybe")
    maybe = marked.where("_tideline_maybe").drop("_tideline_maybe")
    kept = maybe.join(dropped.select(*keys).distinct(), list(keys), "left_anti")
    return clear.unionByName(kept.select(*df.columns)).select(*df.columns)
