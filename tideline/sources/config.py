"""Settings in ``key=value`` lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The setting names and their defaults.
DEFAULTS = {"lsm.ratio": "4", "lsm.c0size": "2000000", "lsm.threadCount": "4", "lsm.bloomFPRate": "0.01"}

#: Entries of a leaf of the buffer.
LEAF_ROWS = 400

_WHOLE = r"^\s*([+-]?[0-9]+)"
_REAL = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


@dataclass(frozen=True)
class Config:
    ratio: int = 4
    c0size: int = 2_000_000
    threads: int = 4
    fp_rate: float = 0.01

    def __post_init__(self) -> None:
        if self.ratio < 2 or self.c0size < 1 or self.threads < 1 or not 0 < self.fp_rate < 1:
            raise ValueError(f"ratio must be 2 or more, c0size and threads 1 or more, and the rate between 0 and 1: {self}")

    @property
    def flush_every(self) -> int:
        """Operations per run: what one of the buffer's two halves holds."""
        return capacity(self.c0size)


def capacity(c0size: int) -> int:
    """Entries of a half of the buffer: whole leaves, one at least."""
    return LEAF_ROWS * ((c0size // 2 + 1) // LEAF_ROWS + 1)


def capacities(sizes: DataFrame) -> DataFrame:
    """``sizes (c0size)`` with ``entries``, the capacity of each."""
    return sizes.withColumn("entries", F.expr(f"{LEAF_ROWS} * ((c0size div 2 + 1) div {LEAF_ROWS} + 1)"))


def parse_config(text: str) -> Config:
    """Settings from the lines of a file: ``#`` in the first column starts a
    comment, names are exact, unknown ones are ignored, the last of a name wins,
    and numbers end where they stop being numbers. A line without a value, or
    with a value out of range, is an error."""
    found = dict(DEFAULTS)
    for line in text.split("\n"):
        if line.startswith("#") or not line:
            continue
        name, *rest = [x for x in line.split("=") if x]
        if name in found:
            if not rest:
                raise ValueError(f"no value: {line}")
            found[name] = rest[0]
    whole = lambda k: int(m[1]) if (m := re.match(_WHOLE, found[k])) else 0
    rate = float(m[1]) if (m := re.match(_REAL, found["lsm.bloomFPRate"])) else 0.0
    return Config(whole("lsm.ratio"), whole("lsm.c0size"), whole("lsm.threadCount"), rate)


def resolve(lines: DataFrame) -> DataFrame:
    """``name, value`` (text of the number) of all settings from ``lines (ord,
    line)``, with the rules of ``parse_config`` but for its range checks."""
    spark = lines.sparkSession
    parts = F.filter(F.split("line", "="), lambda x: x != "")
    given = lines.where(~F.col("line").startswith("#")).select("ord", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("raw"))
    newest = given.where("name is not null").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ord")))).where("n = 1")
    defaults = spark.createDataFrame(list(DEFAULTS.items()), "name string, fallback string")
    number = F.when(F.col("name") == "lsm.bloomFPRate", F.regexp_extract("raw", _REAL, 1)).otherwise(F.regexp_extract("raw", _WHOLE, 1))
    number = F.when(number == "", "0").otherwise(number)
    return defaults.join(newest.select("name", "raw"), "name", "left").select("name", F.coalesce(number, "fallback").cast("double").alias("value"))
