"""Bloom filters and page fences of runs, as relations.

Production reads prune by Parquet's own Bloom filters and min/max statistics
(``sources.store`` writes them); these relations state the same structures
explicitly, with the sizes and hashes of the original design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.murmur import with_murmur3
from .ordinals import with_ordinal

#: Records of a page, and bytes of a record.
PAGE_ROWS = 430
RECORD_BYTES = 12


def bloom_bits(entries: Column, p: Column) -> Column:
    """Bits of a filter: twice the textbook number. The rate has 32-bit precision."""
    rate = p.cast("float").cast("double")
    return (2 * F.ceil(-(entries * F.log(rate)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))).cast("long")


def bloom_hashes(p: Column) -> Column:
    return F.ceil(-(F.log(p.cast("float").cast("double")) / F.log(F.lit(2.0)))).cast("int")


def bloom_positions(keys: DataFrame, bits: Column, hashes: Column) -> DataFrame:
    """``keys`` with a row per hash: ``i`` and ``bit``. A null key has none.

    ``bit`` is declared as never null: a join would otherwise ask for that below
    the hash, and so copy all its steps into one condition.
    """
    present = keys.where("key is not null")
    hashed = with_murmur3(present.withColumn("i", F.explode(F.sequence(F.lit(0), hashes - 1))), F.col("key"), F.col("i"), "bit")
    return hashed.withColumn("bit", F.coalesce(F.col("bit") % bits, F.lit(0).cast("long")))


def bloom_filter(runs: DataFrame, bits: Column, hashes: Column) -> DataFrame:
    """``run_id, bit``: the bits that are set."""
    return bloom_positions(runs.select("run_id", "key"), bits, hashes).select("run_id", "bit").distinct()


def bloom_probe(filters: DataFrame, probes: DataFrame, bits: Column, hashes: Column) -> DataFrame:
    """``key, run_id`` of the probes and runs that answer "maybe": all bits are
    set. It joins on the bit; all other pairs are a certain "no" and have no row."""
    asked = bloom_positions(probes.select("key").distinct(), bits, hashes).select("key", "bit").distinct()
    need = asked.groupBy("key").agg(F.count(F.lit(1)).alias("need"))
    met = asked.join(filters, "bit").groupBy("key", "run_id").agg(F.count(F.lit(1)).alias("met"))
    return met.join(need, "key").where("met = need").select("key", "run_id")


def fence_pages(runs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``run_id, page, page_max``: the largest key of each page of a run."""
    placed = with_ordinal(runs.select("run_id", "key"), ["run_id"], "key", "place")
    return placed.groupBy("run_id", F.expr(f"cast(place div {page_rows} as int)").alias("page")).agg(F.max("key").alias("page_max"))


def fence_lookup(pages: DataFrame, probes: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``run_id, key, page, address``: the first page whose largest key is not
    below the probe, and its byte address. Null beyond the last page, where a
    reader starts at the run's begin."""
    runs = pages.select("run_id").distinct()
    every = probes.select("key").distinct().crossJoin(runs)  # the result has these rows
    # Merge by order within the run: the next fence at or after the probe.
    rows = pages.select("run_id", F.col("page_max").alias("key"), "page", F.lit(1).alias("fence")).unionByName(
        every.select("run_id", "key", F.lit(None).cast("int").alias("page"), F.lit(0).alias("fence"))
    )
    rows = rows.withColumn("page", F.expr("first(page, true) over (partition by run_id order by key, fence rows between current row and unbounded following)"))
    return rows.where("fence = 0").select("run_id", "key", "page", (F.col("page").cast("long") * (page_rows * RECORD_BYTES)).alias("address"))
