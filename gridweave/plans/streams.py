"""Streaming queries: each runs to the end of its input and reads its result back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import work_path
from ..sources.readers import read_json_payloads
from ..streaming.ingest import ingest_stream, ingested_messages
from ..streaming.state import ROCKSDB, cell_changes, changed_cells
from ..streaming.triggers import look_back, look_back_children, on_status, on_trigger_once, run_available, webhook_outbox
from .common import table

NOW = "2024-01-20 00:00:00"


@contextmanager
def stream_settings(spark: SparkSession, **extra: str) -> Iterator[None]:
    """Session settings of a stateful run, put back afterwards.

    Every shuffle partition of a stateful stream is a state store with its own worker,
    so there are at most two per core; on a large cluster the session's number stays.
    """
    cores = spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores)), **extra}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def event_stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def status_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cell edits; a purchase sets the status of a task to Completed."""
    e = event_stream(spark, sf)
    edits = e.select(
        F.when(F.col("user_id") == 0, "Projects").otherwise("Tasks").alias("table"),
        F.when(F.col("event_type") == "view", "Title").otherwise("Status").alias("column"),
        F.when(F.col("event_type").isin("purchase", "view"), "Completed").otherwise("Open").alias("new_value"),
        "event_id", "user_id", "event_type",
    )
    path = work_path(spark, "status")
    webhook_outbox(on_status(edits, ["event_id", "user_id", "event_type"]).select("event_id", "payload"), path, path + "_log")
    return spark.read.parquet(path).select("event_id", "payload")


STATUS_PAYLOADS_SQL = """SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS payload
FROM events WHERE event_type = 'purchase' AND user_id <> 0"""


def trigger_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every flagged row is delivered twice a run and must be sent once; the second run brings
    the rows before NOW, all late, and those of the first run again."""
    e = table(spark, sf, "events")
    source, path = work_path(spark, "flags"), work_path(spark, "trigger")
    with stream_settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        for part in (e.where(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz")), e):
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(e.schema).parquet(source).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
            edits = stream.select(
                "event_id", "ts", "event_type", "user_id",
                F.when(F.col("event_type") == "click", "Trigger").otherwise("").alias("flag"),
                F.when(F.col("user_id") < 10, "Processed").alias("state"),
            )
            once = on_trigger_once(edits, "event_id", "ts", {"Description": "event_type", "User": "user_id"}, "event_id")
            run_available(once.select("event_id", "payload"), path, path + "_log")
    return spark.read.parquet(path)


TRIGGER_ONCE_SQL = """SELECT event_id, '{"Description":"click","User":' || user_id || ',"RowNumber":' || event_id || '}' AS payload FROM events WHERE event_type = 'click' AND user_id >= 10"""


def message_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Messages arrive in several files, each message through two members; one file per batch."""
    m = table(spark, sf, "conversations").select(
        F.concat(F.lit("spaces/"), "conv_id", F.lit("/messages/"), "turn").alias("message_id"), "role", "text"
    )
    source = work_path(spark, "inbox")
    m.withColumn("member", F.explode(F.array(F.lit("anna"), F.lit("bert")))).repartition(4).write.parquet(source)
    target = work_path(spark, "messages")
    stream = spark.readStream.schema("message_id string, role string, text string, member string").option("maxFilesPerTrigger", 1).parquet(source)
    ingest_stream(stream, target, target + "_log", "message_id", "member", F.lit(NOW).cast("timestamp_ntz"))
    return ingested_messages(spark, target, "message_id", "member", "last_updated")


MESSAGE_STREAM_SQL = f"SELECT 'spaces/' || conv_id || '/messages/' || turn AS message_id, role, text, TIMESTAMP '{NOW}' AS last_updated FROM conversations"


def recent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Look-back of 24 hours over the event stream."""
    recent = look_back(event_stream(spark, sf), "ts", F.lit(NOW).cast("timestamp_ntz"))
    path = work_path(spark, "recent")
    run_available(recent.select("event_id", "ts"), path, path + "_log")
    return spark.read.parquet(path)


RECENT_EVENTS_SQL = f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"


def space_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of the last 24 hours in spaces active within them: two streams joined, the newer half of the rows arrives first.

    A purchase is a report of a space's activity, any other event a message.
    """
    now, half = (F.lit(t).cast("timestamp_ntz") for t in (NOW, "2024-01-19 12:00:00"))
    spaces, messages, out = (work_path(spark, n) for n in ("spaces", "sent", "active"))
    e = table(spark, sf, "events").where(F.col("ts") <= now)
    report = F.col("event_type") == "purchase"
    # The third format keeps both sides of a partition in one store; the default has four.
    one_store = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.join.stateFormatVersion": "3"}
    with stream_settings(spark, **one_store):
        for part in (e.where(F.col("ts") > half), e.where(F.col("ts") <= half)):
            part.where(report).select(F.col("user_id").alias("space"), F.col("ts").alias("last_active")).write.mode("append").parquet(spaces)
            part.where(~report).select("event_id", F.col("user_id").alias("space"), F.col("ts").alias("created")).write.mode("append").parquet(messages)
            parents = spark.readStream.schema("space bigint, last_active timestamp_ntz").parquet(spaces)
            children = spark.readStream.schema("event_id bigint, space bigint, created timestamp_ntz").parquet(messages)
            run_available(look_back_children(parents, children, "space", "last_active", "created", now), out, out + "_log")
    return spark.read.parquet(out)


SPACE_MESSAGES_SQL = f"""WITH r AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}')
SELECT event_id, user_id AS space, ts AS created FROM r WHERE event_type <> 'purchase' AND ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
AND user_id IN (SELECT user_id FROM r WHERE event_type = 'purchase')"""


def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that differ between two versions of the orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.withColumn("o_orderstatus", F.lit("F")).withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )
    return changed_cells(o, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


ORDER_CHANGES_SQL = """SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS old, 'F' AS new FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, NULL FROM orders WHERE o_orderpriority = '5-LOW'"""

# Where the second and the third of the three files of the next queries begin.
_CUTS = ("2024-01-11", "2024-01-21")


def _parts(events: DataFrame) -> list[DataFrame]:
    """Three parts that hold every event once; the first and the last are open-ended, events without a time are in the last."""
    ts = F.col("ts")
    low, high = (F.lit(c).cast("timestamp_ntz") for c in _CUTS)
    return [events.where(ts < low), events.where((ts >= low) & (ts < high)), events.where((ts >= high) | ts.isNull())]


def cell_change_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Stateful stream: users whose last event type changed from one run to the next."""
    path, out = work_path(spark, "days"), work_path(spark, "changes")
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    with stream_settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        for part in _parts(events):
            part.write.mode("append").parquet(path)
            source = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").parquet(path)
            run_available(cell_changes(source, "user_id", "event_type", "event_id"), out, out + "_log")
    return spark.read.parquet(out).select(F.col("key").cast("bigint").alias("user_id"), "old", "new", F.col("seq").alias("event_id"))


CELL_CHANGE_SQL = """WITH d AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS p FROM events),
l AS (SELECT user_id, p, arg_max(event_type, event_id) AS new, max(event_id) AS event_id FROM d GROUP BY 1, 2),
c AS (SELECT user_id, lag(new) OVER (PARTITION BY user_id ORDER BY p) AS old, new, event_id FROM l)
SELECT user_id, old, new, event_id FROM c WHERE old <> new"""


def appended_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as received bodies; every one becomes a row, in three resumed runs."""
    source, out = work_path(spark, "bodies"), work_path(spark, "rows")
    e = table(spark, sf, "events")
    bodies = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(
        F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "category": "'), "event_type", F.lit('"}'))
    )
    for part in _parts(e):
        part.select(bodies.alias("value")).write.mode("append").text(source)
        stream = read_json_payloads(spark, source, "event_id bigint, category string", ["event_id"], streaming=True)
        run_available(stream, out, out + "_log")
    rows = spark.read.parquet(out)
    return rows.groupBy("category", "error").agg(F.count("*").alias("rows"), F.sum("event_id").alias("id_sum"))


APPENDED_PAYLOADS_SQL = """SELECT CASE WHEN event_type <> 'error' THEN event_type END AS category, CASE WHEN event_type = 'error' THEN 'Invalid JSON' END AS error, count(*) AS rows,
CAST(sum(CASE WHEN event_type <> 'error' THEN event_id END) AS BIGINT) AS id_sum FROM events GROUP BY 1, 2"""


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Message cells of the chat sheet: ids, fallbacks, local date and time."""
    e = table(spark, sf, "events")
    day, clock = V.split_timestamp(F.col("ts"))
    return e.select(
        "event_id",
        V.resource_id(F.concat(F.lit("users/"), F.col("user_id").cast("string"))).alias("sender_id"),
        V.first_text(F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")), F.lit("Not in Contacts")).alias("sender_name"),
        day.alias("sent_date"), clock.alias("sent_time"), V.iso_timestamp(F.col("ts")).alias("sent_at"),
    )


CHAT_MESSAGES_SQL = """SELECT event_id, CAST(user_id AS VARCHAR) AS sender_id, CASE WHEN event_type = 'view' THEN 'Not in Contacts' ELSE event_type END AS sender_name,
strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS sent_date, strftime(ts - INTERVAL 6 HOUR, '%H:%M:%S') AS sent_time, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS sent_at FROM events"""

_NAMES = (
    "status_payloads:STATUS_PAYLOADS_SQL trigger_once:TRIGGER_ONCE_SQL message_stream:MESSAGE_STREAM_SQL recent_events:RECENT_EVENTS_SQL space_messages:SPACE_MESSAGES_SQL "
    "order_changes:ORDER_CHANGES_SQL cell_change_stream:CELL_CHANGE_SQL appended_payloads:APPENDED_PAYLOADS_SQL chat_messages:CHAT_MESSAGES_SQL"
)
QUERIES = {n: globals()[n] for n in (x.split(":")[0] for x in _NAMES.split())}
ORACLES = {n: globals()[s] for n, s in (x.split(":") for x in _NAMES.split())}
