"""Row numbers of sorted tables without one task that sorts everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import write_shared

#: Two to this power buckets; a window numbers the rows of one bucket.
BITS = 11


def with_ordinal(df: DataFrame, within: list[str], key: str, name: str = "ord", start: int = 0, order: list[Column] | None = None) -> DataFrame:
    """``df`` with the place of each row by ``key`` among rows of equal ``within``.

    ``df`` is written once. Approximate quantiles of ``key`` cut it into buckets
    of about equal size, wherever its values lie; rows are counted per bucket, and
    a row's number is the count of the buckets before its own plus its place
    within. The windows over bucket counts see a row per bucket and group. Rows
    with the same key share a bucket; ``order`` settles their ties.
    """
    buckets = 1 << BITS
    held = write_shared(df, "ordered")
    shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    bounds = held.agg(F.percentile_approx(key, shares, F.lit(5 * buckets)).alias("_bounds"))
    # The number of bounds that a key exceeds, by bisection; bounds are null where there are no rows.
    bisected = F.expr(f"aggregate(sequence({BITS - 1}, 0, -1), 0, (a, s) -> if(get(_bounds, a + shiftleft(1, s) - 1) < `{key}`, a + shiftleft(1, s), a))")
    placed = held.join(F.broadcast(bounds)).withColumn("_bucket", bisected).drop("_bounds")  # one row
    inner = Window.partitionBy(*within, "_bucket").orderBy(key, *(order or []))
    counts = placed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by = within or [F.lit(0)]
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = placed.withColumn("_rank", F.row_number().over(inner) - 1)
    right = before.select(*(F.col(c).alias(f"_r_{c}") for c in [*within, "_bucket"]), "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*within, "_bucket"]])
    return numbered.join(right, same).withColumn(name, F.col("_rank") + F.col("_before") + start).select(*df.columns, name)
