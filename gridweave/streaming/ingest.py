"""Idempotent message ingest from a stream.

Batches are written as they come, each to its own folder that a replay replaces.
The table of messages is a view over those folders: the first copy of a message
gives its cells, the last batch that saw it gives its touch time. So no batch ever
rewrites, or even reads, the messages that are already there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import first_per_key


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, stamp: Column) -> StreamingQuery:
    """Write micro-batches of messages, one row per message id and batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        once = first_per_key(batch, [key], [order]).withColumn("_touched", stamp)
        once.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingested_messages(spark: SparkSession, path: str, key: str, order: str, touched: str) -> DataFrame:
    """Current message table."""
    log = spark.read.parquet(path)
    cells = [c for c in log.columns if c not in (key, "_touched", "batch_id")]
    return log.groupBy(key).agg(
        F.min_by(F.struct(*cells), F.struct("batch_id", order)).alias("_first"), F.max("_touched").alias(touched)
    ).select(key, *[F.col(f"_first.`{c}`").alias(c) for c in cells if c != order], touched)
