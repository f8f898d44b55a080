"""Lookups and range scans.

Requests are tables: ``ticket, key`` for gets, ``ticket, lo, hi`` for ranges
(``lo`` included, ``hi`` excluded), with ``seq`` where they see the log as of a
position. Tickets are unique. A miss and a tombstone both give the output ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .oplog import latest, live
from .ordinals import with_ordinal

#: Operations of a key that one window of an as-of lookup holds at most.
BLOCK = 1 << 20


def status(is_delete: Column) -> Column:
    return F.when(is_delete.isNull(), "MISSING").when(is_delete, "DELETED").otherwise("FOUND")


def _output(found: DataFrame, *columns: str) -> DataFrame:
    shown = F.when(F.col("status") == "FOUND", F.coalesce(F.col("value").cast("string"), F.lit(""))).otherwise("")
    return found.withColumn("status", status(F.col("is_delete"))).withColumn("output", shown).select(*columns, "key", "status", "output")


def point_get(ops: DataFrame, key: int) -> DataFrame:
    """``key, status, output``, one row. The key's filter reaches the scan."""
    newest = ops.where(F.col("key") == key).agg(F.max_by("is_delete", "seq").alias("is_delete"), F.max_by("value", "seq").alias("value"))
    return _output(newest.withColumn("key", F.lit(key)))


def multi_get(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """``ticket, key, status, output`` per request. Operations of other keys are
    left out before they are aggregated. A null key is missing."""
    wanted = requests.select("key").distinct()
    found = latest(ops.join(wanted, "key", "left_semi"))
    return _output(requests.select("ticket", "key").join(found, "key", "left"), "ticket")


def asof(ops: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """``asked (key, seq, ...)`` with ``is_delete`` and ``value`` of the newest
    operation of the key at or before ``seq``, nulls where there is none.

    Linear in the log: operations and requests are merged in order of seq and the
    last operation is carried on. Blocks of seq bound what one window holds of a
    hot key: within a block rows are carried one by one, and across blocks only
    each block's last operation.
    """
    wanted = asked.select("key").distinct()
    at = F.floor(F.col("seq") / block).cast("long")
    others = [c for c in asked.columns if c not in ("key", "seq")]
    log = ops.join(wanted, "key", "left_semi").select("key", "seq", at.alias("block"), "is_delete", "value")
    asked = asked.select(F.struct(*others).alias("who"), "key", "seq", at.alias("block"))
    none = [F.lit(None).cast("boolean").alias("is_delete"), F.lit(None).cast(ops.schema["value"].dataType).alias("value")]
    nobody = F.lit(None).cast(asked.schema["who"].dataType).alias("who")

    def carried(rows: DataFrame, by: list[str], order: list[str], frame: tuple[int, int]) -> DataFrame:
        here = F.when(F.col("is_delete").isNotNull(), F.struct("is_delete", "value"))
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*frame)
        return rows.withColumn("last", F.last(here, ignorenulls=True).over(w))

    near = log.select(nobody, "key", "seq", "block", F.lit(0).alias("asks"), "is_delete", "value").unionByName(
        asked.select("who", "key", "seq", "block", F.lit(1).alias("asks"), *none)
    )
    near = carried(near, ["key", "block"], ["seq", "asks"], (Window.unboundedPreceding, 0)).where("asks = 1").select("who", "key", "seq", "block", "last")
    ends = latest(log, by=("key", "block")).withColumn("asks", F.lit(0))
    blocks = ends.unionByName(asked.select("key", "block", *none, F.lit(1).alias("asks")).distinct())
    # A block's own end comes after its requests, so they see the ends of the blocks before.
    before = carried(blocks, ["key"], ["block", F.desc("asks")], (Window.unboundedPreceding, 0)).where("asks = 1").select("key", "block", F.col("last").alias("earlier"))
    found = near.join(before, ["key", "block"], "left").withColumn("last", F.coalesce("last", "earlier"))
    return found.select("who.*", "key", "seq", "last.is_delete", "last.value")


def asof_get(ops: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """``ticket, key, status, output`` of ``requests (ticket, seq, key)``: what
    the newest operation at or before ``seq`` says."""
    return _output(asof(ops, requests.select("ticket", "key", "seq"), block), "ticket")


def range_scan(ops: DataFrame, lo: int, hi: int) -> DataFrame:
    """``key, value`` of live keys in [lo, hi); the bounds reach the scan."""
    return live(latest(ops.where((F.col("key") >= lo) & (F.col("key") < hi))))


def _cells(requests: DataFrame, *carry: str) -> DataFrame:
    """``requests`` with a row per cell that covers their range: ``_width`` (a
    power of two near a sixteenth of the range's own) and ``_cell``; 17 at most."""
    span = F.col("hi").cast("long") - F.col("lo").cast("long")
    asked = requests.where("lo < hi").select("ticket", F.col("lo").cast("long").alias("_lo"), F.col("hi").cast("long").alias("_hi"), *carry, F.greatest(F.ceil(F.log2(span)) - 4, F.lit(0)).cast("int").alias("_width"))
    return asked.withColumn("_cell", F.explode(F.expr("sequence(shiftright(_lo, _width), shiftright(_hi - 1, _width))")))


def _placed(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows``, once per width in use (32 at most), with the cell of their key."""
    widths = asked.agg(F.array_sort(F.collect_set("_width")).alias("_widths"))
    return rows.join(F.broadcast(widths)).withColumn("_width", F.explode("_widths")).withColumn("_cell", F.expr("shiftright(cast(key as bigint), _width)")).drop("_widths")


def in_ranges(rows: DataFrame, requests: DataFrame, *carry: str) -> DataFrame:
    """``rows`` with the ``ticket`` (and ``carry``) of each request they lie in:
    an equi-join on the cell and not a nested loop."""
    asked = _cells(requests, *carry)
    return _placed(rows, asked).join(asked, ["_width", "_cell"]).where("key >= _lo and key < _hi").drop("_width", "_cell", "_lo", "_hi")


def near_ranges(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """The operations in cells of any request: a superset of those in ranges, and
    repeated where cells of several widths hold them. Newest-wins needs no more."""
    asked = _cells(requests)
    cells = asked.select("_width", "_cell").distinct()
    return _placed(ops, asked).join(cells, ["_width", "_cell"], "left_semi").drop("_width", "_cell")


def _live_in(ops: DataFrame, requests: DataFrame) -> DataFrame:
    asked = requests.select("ticket", "lo", "hi")
    return in_ranges(live(latest(near_ranges(ops, asked))), asked)


def multi_range(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """``ticket, ord, key, value`` of every request's live keys, in key order.
    Operations that no request can need are left out before they are aggregated."""
    return with_ordinal(_live_in(ops, requests), ["ticket"], "key").select("ticket", "ord", "key", "value")


def asof_range(ops: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """As ``multi_range`` of ``requests (ticket, seq, lo, hi)``, each as of its
    position. Requests meet the distinct keys, not the log, and each key that one
    holds is looked up as of its position, linear in the log."""
    asked = requests.select("ticket", F.col("seq").alias("_until"), "lo", "hi")
    pairs = in_ranges(ops.select("key").distinct(), asked, "_until")
    found = live(asof(ops, pairs.select("ticket", "key", F.col("_until").alias("seq")), block))
    return with_ordinal(found.select("ticket", "key", "value"), ["ticket"], "key").select("ticket", "ord", "key", "value")


def range_counts(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """``ticket, n, min_key, max_key`` per request, empty ranges included."""
    found = _live_in(ops, requests).groupBy("ticket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return requests.select("ticket").join(found, "ticket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def render_ranges(found: DataFrame, requests: DataFrame) -> DataFrame:
    """``ticket, line``: ``key:value `` per row of a request, in key order; an
    empty range gives the empty line. A line holds its whole range."""
    pair = F.struct("key", F.concat("key", F.lit(":"), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit(" ")).alias("text"))
    lines = found.groupBy("ticket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["text"]), "").alias("line"))
    return requests.select("ticket").join(lines, "ticket", "left").withColumn("line", F.coalesce("line", F.lit("")))
