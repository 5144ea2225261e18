"""Change triggers, payload outboxes and look-back windows as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reshape import renamed_payload, row_payload

# What the two triggers react to.
TRIGGER_FLAG, PROCESSED = "Trigger", "Processed"
LOOK_BACK_HOURS = 24


def on_status(edits: DataFrame, cols: list[str], table: str = "Tasks", column: str = "Status", value: str = "Completed") -> DataFrame:
    """Edits that set ``column`` of ``table`` to ``value``, with the whole row as payload."""
    hit = (F.col("table") == table) & (F.col("column") == column) & (F.col("new_value") == value)
    return edits.where(hit).withColumn("payload", row_payload(cols))


def on_trigger_once(edits: DataFrame, key: str, ts: str, names: dict[str, str], row_no: str) -> DataFrame:
    """Flagged rows that are not processed yet, each key once over all runs of a checkpoint.

    The sent keys stay in the stream's state for good: there is no watermark, so ``ts`` plays no
    part, a late row is sent like any other and a key that comes again is never sent twice. The
    state grows with the keys; with the RocksDB provider it lies on disk.
    """
    wanted = edits.where((F.col("flag") == TRIGGER_FLAG) & ~F.col("state").eqNullSafe(PROCESSED))
    return wanted.dropDuplicates([key]).withColumn("payload", renamed_payload(names, row_no))


def look_back(events: DataFrame, ts: str, now: Column, hours: int = LOOK_BACK_HOURS, inclusive: bool = False) -> DataFrame:
    """Events newer than ``now`` minus ``hours`` (at least, when ``inclusive``)."""
    bound = now - F.expr(f"INTERVAL {hours} HOURS")
    return events.where(F.col(ts) >= bound if inclusive else F.col(ts) > bound)


def late_limit(events: DataFrame, ts: str, hours: int = LOOK_BACK_HOURS) -> DataFrame:
    """Streaming form of the look-back: later rows than that are dropped by state operators."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{hours} hours")


def look_back_children(
    parents: DataFrame, children: DataFrame, key: str, active: str, created: str, now: Column, hours: int = LOOK_BACK_HOURS, salts: int = 8
) -> DataFrame:
    """Children created after ``now`` less ``hours`` whose parent was active at or after that time; both may be streams.

    The times of a pair lie at most ``hours`` apart, as do those of all rows of one look-back, so the
    state holds the rows of that span only. A row more than ``hours`` behind the newest row of the
    slower stream is dropped as late; where ``now`` isn't before the newest row, it is outside the
    look-back anyway. Rows without key or time find nothing. A child comes once, however often its
    parent reports. The children of one key are spread by time over ``salts`` tasks, and each has the parent.
    """
    span = F.expr(f"INTERVAL {hours} HOURS")
    p = look_back(parents, active, now, hours, inclusive=True).select(
        F.col(key).alias("_key"), F.col(active).cast("timestamp").alias("_active"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_part"),
    )
    c = look_back(children, created, now, hours).withColumns({
        "_created": F.col(created).cast("timestamp"), "_salt": F.pmod(F.xxhash64(created), F.lit(salts)).cast("int"),
    })
    near = F.col("_created").between(F.col("_active") - span, F.col("_active") + span)
    same = (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part"))
    return late_limit(c, "_created", hours).join(late_limit(p, "_active", hours), same & near, "leftsemi").drop("_created", "_salt")


def run_available(df: DataFrame, path: str, checkpoint: str, output: str = "append") -> StreamingQuery:
    """Process everything available, resume where the last run stopped, then end."""
    query = (
        df.writeStream.format("parquet").outputMode(output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def webhook_outbox(payloads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One payload row per triggered row; a replayed batch replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
