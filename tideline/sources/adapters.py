"""Operation logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import as_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(events: DataFrame) -> DataFrame:
    """Users as keys: an error deletes, any other event puts its value in cents."""
    return as_log(events, F.col("event_id"), F.col("user_id").cast("int"), F.col("event_type") == "error", F.floor(F.col("value") * 100).cast("int"))


def ops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(table(spark, sf_dir, "events"))


def ops_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keys: an order with status F deletes, others put their price."""
    orders = table(spark, sf_dir, "orders")
    return as_log(orders, F.col("o_orderkey"), F.col("o_custkey").cast("int"), F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("int"))


#: No one column orders lineitem; all of them together do.
LINEITEM_ORDER = "l_shipdate l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()


def ops_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as keys: a returned item deletes, others put their price. ``seq`` is
    a struct of all columns."""
    items = table(spark, sf_dir, "lineitem")
    return as_log(items, F.struct(*LINEITEM_ORDER), F.col("l_partkey").cast("int"), F.col("l_returnflag") == "R", F.floor("l_extendedprice").cast("int"))
