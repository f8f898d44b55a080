"""State kept up to date by a stream of operations.

The state of a key is its newest operation by ``seq``, so late and repeated rows
need no watermark: they change nothing once something newer is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def stream_latest(ops: DataFrame, root: str | None = None) -> DataFrame:
    """Take in all that a streaming log (``seq, key, is_delete, value``) has now,
    and return ``key, is_delete, value``. With the same ``root`` a later call
    takes in only what is new.

    The query updates its state in the store; each batch's changed keys go to a
    table, and the newest change of a key is its state.
    """
    spark = ops.sparkSession
    root = root or f"{shared_dir(spark)}/tideline/stream-{uuid.uuid4().hex}"
    changes = f"{root}/changes"
    newest = ops.groupBy("key").agg(F.max_by("is_delete", "seq").alias("is_delete"), F.max_by("value", "seq").alias("value"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    query = newest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(changes)
    schema = "key int, is_delete boolean, value int, batch int"
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).drop("batch")
    found = spark.read.schema(schema).parquet(changes)
    return found.groupBy("key").agg(F.max_by("is_delete", "batch").alias("is_delete"), F.max_by("value", "batch").alias("value"))
