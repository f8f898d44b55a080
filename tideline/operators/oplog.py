"""State from an operation log.

A log is a DataFrame ``seq, key, is_delete, value`` (further columns are
ignored). Its state is each key's newest operation; deletes are dropped only
after that, for a delete hides older puts.

Defined results: rows with a null key are no operations; a null ``is_delete``
counts as false; a put may have a null value, which is kept; ``seq`` must be
unique per key (of operations with equal key and seq any one may win); an empty
log gives an empty state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_log(df: DataFrame, seq: Column, key: Column, is_delete: Column, value: Column) -> DataFrame:
    """A log from any table; the value of a delete is null."""
    delete = F.coalesce(is_delete, F.lit(False))
    return df.select(seq.alias("seq"), key.alias("key"), delete.alias("is_delete"), F.when(~delete, value).alias("value")).where("key is not null")


def latest(ops: DataFrame, order: str = "seq", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """``key, is_delete, value``: each key's newest operation, deletes included.

    Two ``max_by`` over primitive columns stay in hash aggregation and combine
    before the shuffle, so a key with a third of all operations is no burden.
    """
    return ops.groupBy(*by).agg(F.max_by("is_delete", order).alias("is_delete"), F.max_by("value", order).alias("value"))


def live(state: DataFrame) -> DataFrame:
    return state.where("not is_delete").drop("is_delete")


def state(ops: DataFrame, order: str = "seq") -> DataFrame:
    """``key, value`` of the live keys."""
    return live(latest(ops, order))


def tombstones(ops: DataFrame) -> DataFrame:
    """Keys whose newest operation is a delete."""
    return latest(ops).where("is_delete").select("key")


def revived(ops: DataFrame) -> DataFrame:
    """``key, value, n_deletes`` of live keys that were deleted before."""
    found = ops.groupBy("key").agg(
        F.max_by("is_delete", "seq").alias("is_delete"),
        F.max_by("value", "seq").alias("value"),
        F.count_if("is_delete").alias("n_deletes"),
    )
    return found.where("not is_delete and n_deletes > 0").select("key", "value", "n_deletes")
