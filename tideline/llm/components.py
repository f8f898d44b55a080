"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` for every node in ``edges (a, b)``; a component is
    named by its smallest node. Nulls and loops are ignored, an empty table gives
    an empty result.

    Each round lets every node point its larger, then its smaller neighbours to
    the smallest one it knows (large-star, small-star), which needs a number of
    rounds that is logarithmic in the longest path, not proportional to it. Each
    round is written to the shared folder. The minimum per node is aggregated
    before its shuffle, and the join that hands it back is an equi-join that
    adaptive execution can split at hub nodes.
    """
    now = write_shared(_directed(edges.select("a", "b")), label)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = state
        now = write_shared(_small_star(_large_star(now)), label)


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node ``a`` to the smaller ``b``."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return _directed(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(met.unionByName(least.select("a", F.col("m").alias("b"))))
