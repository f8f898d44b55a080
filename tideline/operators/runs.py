"""Sorted runs, tiered levels, and what they hold.

A log is cut into segments of ``flush_every`` positions; a full segment is
flushed as one run (each key's newest operation, deletes kept), and what comes
after the last full segment is the buffer. Level 1 holds up to ``2 * ratio``
runs, deeper levels ``ratio``; at a flush that finds level 1 full, all contiguous
full levels are each merged into one run of the next level, deepest first.

So the layout follows from the number of flushes alone. Level i has received
``n[i]`` runs, ``n[i+1] = (n[i] - 1) div cap[i]``, and holds those that are not
merged on; a run of level i covers as many flushes as the caps above it multiply
to. Level 0 is the buffer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .oplog import latest


@dataclass(frozen=True)
class Level:
    """``first``, ``last``: the flushes (from 0, last excluded) that it holds, in
    runs of ``unit`` flushes each."""

    level: int
    unit: int
    first: int
    last: int

    @property
    def runs(self) -> int:
        return (self.last - self.first) // self.unit


def layout(flushes: int, ratio: int) -> list[Level]:
    """Levels from shallow to deep after so many flushes."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    out, n, unit, cap, level = [], flushes, 1, 2 * ratio, 1
    while n >= 1:
        merged = (n - 1) // cap
        out.append(Level(level, unit, merged * cap * unit, n * unit))
        n, unit, cap, level = merged, unit * cap, ratio, level + 1
    return out


def flush_count(ops: DataFrame, flush_every: int) -> int:
    """Full segments of the log, from its last position (one small job)."""
    top = ops.agg(F.max("seq")).first()[0]
    return 0 if top is None else (int(top) + 1) // flush_every


def flushed(ops: DataFrame, flush_every: int) -> DataFrame:
    """``run_id, key, is_delete, value``: the newest operation per run and key."""
    return latest(ops.withColumn("run_id", F.expr(f"seq div {flush_every}")), by=("run_id", "key"))


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_delete").alias("delete_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def merged(runs: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Many runs as one: the newest run's record per key, deletes kept."""
    return latest(runs, "run_id", by)


def shadowed_out(runs: DataFrame) -> DataFrame:
    """Records that no newer run shadows, by an anti-join on the key. It equals
    ``merged`` and is there to check it against."""
    newer = runs.select(F.col("key").alias("_key"), F.col("run_id").alias("_run"))
    return runs.join(newer, (F.col("key") == F.col("_key")) & (F.col("_run") > F.col("run_id")), "left_anti").select("key", "is_delete", "value")


def _by_level(flush: Column, levels: list[Level], value) -> Column:
    """A level's value for a flush; flushes after all levels are the buffer's."""
    out = F.lit(0).cast("long")
    for x in reversed(levels):  # the shallowest level that reaches back so far
        out = F.when((flush >= x.first) & (flush < x.last), value(x)).otherwise(out)
    return out


def with_level(df: DataFrame, flush: Column, levels: list[Level]) -> DataFrame:
    """``df`` with ``level`` and ``run`` (its number among all runs that the level
    ever received; for the buffer, 0)."""
    return df.withColumn("level", _by_level(flush, levels, lambda x: F.lit(x.level).cast("long")).cast("int")).withColumn(
        "run", _by_level(flush, levels, lambda x: F.floor(flush / x.unit).cast("long"))
    )


def contents(ops: DataFrame, flush_every: int, ratio: int, flushes: int | None = None) -> DataFrame:
    """``level, run, key, is_delete, value``: all that is held after the log has
    been taken in; level 0 is the buffer."""
    n = flush_count(ops, flush_every) if flushes is None else flushes
    placed = with_level(ops, F.expr(f"seq div {flush_every}"), layout(n, ratio))
    return latest(placed, by=("level", "run", "key"))


def label(level: Column) -> Column:
    """Levels count from 1 with the buffer: ``L01``, ``L02``, ..."""
    return F.concat(F.lit("L"), F.lpad((level + 1).cast("string"), 2, "0"))


def summary_total(held: DataFrame) -> DataFrame:
    """``physical_pairs``: live records over all runs, also shadowed ones;
    ``live_keys``: keys whose newest record is live."""
    newest = merged(held.withColumn("run_id", F.col("run") - F.col("level") * (1 << 40)))
    return held.agg(F.count_if(~F.col("is_delete")).alias("physical_pairs")).join(newest.agg(F.count_if(~F.col("is_delete")).alias("live_keys")))


def summary_levels(held: DataFrame, levels: list[Level]) -> DataFrame:
    """``level, label, pairs`` per level; the buffer only if it has pairs, other
    levels always."""
    pairs = held.groupBy("level").agg(F.count_if(~F.col("is_delete")).alias("pairs"))
    every = held.sparkSession.createDataFrame([(x.level,) for x in levels], "level int")
    of_disk = every.join(pairs, "level", "left").select("level", F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"))
    return pairs.where("level = 0 and pairs > 0").unionByName(of_disk).select("level", F.concat(F.lit("LVL"), (F.col("level") + 1).cast("string")).alias("label"), "pairs")


def summary_rollup(held: DataFrame) -> DataFrame:
    """``level, run, pairs, tombstones`` per run, per level and in all."""
    return held.rollup("level", "run").agg(F.count_if(~F.col("is_delete")).alias("pairs"), F.count_if("is_delete").alias("tombstones"))


def amplification(held: DataFrame) -> DataFrame:
    """``key, n_runs, n_shadowed``: runs that hold a key, and its records there
    that a newer one hides."""
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n_runs"), (F.count(F.lit(1)) - 1).alias("n_shadowed"))


def winning_run(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """``ticket, key, run_id, status``: the newest run that has the key."""
    wanted = requests.select("key").distinct()
    found = runs.join(wanted, "key", "left_semi").groupBy("key").agg(F.max("run_id").alias("run_id"), F.max_by("is_delete", "run_id").alias("is_delete"))
    shown = F.when(F.col("is_delete").isNull(), "MISSING").when(F.col("is_delete"), "DELETED").otherwise("FOUND")
    return requests.select("ticket", "key").join(found, "key", "left").select("ticket", "key", "run_id", shown.alias("status"))
