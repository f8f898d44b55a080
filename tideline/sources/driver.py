"""The whole program: a configuration and a command script in, what it prints out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commands import is_error, is_malformed, run_script
from .config import Config, parse_config


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord, line`` of text files: places from 0, in order of the files' names.

    Readers take files in splits of bounded size and in order within each. Lines
    are counted per split, and a line's place is the count of the splits before
    its own plus its place within; one window sees a row per split.
    """
    place = F.col("_metadata")
    rows = spark.read.text(path).select(F.col("value").alias("line"), place["file_path"].alias("file"), place["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"))
    counts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", "start", F.expr("coalesce(sum(n) over (partition by 0 order by file, start rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    within = rows.withColumn("at", F.expr("row_number() over (partition by file, start order by id)") - 1)
    return within.join(before, ["file", "start"]).select((F.col("before") + F.col("at")).alias("ord"), "line")


def read_config(spark: SparkSession, path: str | None) -> Config:
    """Settings from a file, or the defaults without one."""
    if path is None:
        return Config()
    return parse_config("\n".join(r["line"] for r in numbered_lines(spark, path).orderBy("ord").collect()))


def run_files(spark: SparkSession, script: str, config: str | None = None, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """``ord, output`` of a script file under a configuration file."""
    settings = read_config(spark, config)
    return run_script(spark, numbered_lines(spark, script), settings.flush_every, settings.ratio, load)


def printed(spark: SparkSession, script: str, config: str | None = None) -> Iterator[tuple[str, bool]]:
    """What the program prints, piece by piece, and whether that is an error.
    Results, summaries and most messages end their lines; the message of a
    malformed command does not."""
    for r in run_files(spark, script, config).toLocalIterator():
        yield r["output"] + ("" if is_malformed(r["output"]) else "\n"), is_error(r["output"])
