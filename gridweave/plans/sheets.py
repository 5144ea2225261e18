"""Header, sync and reshape queries over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import headers as H
from ..operators import reshape as R
from ..operators import sync as S
from ..operators.ordering import first_k_per_group, first_rows, number_rows, random_row
from ..session import work_path
from ..sources.readers import SHEET_DATE_FORMATS, parse_payloads, read_sheet
from .common import table

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---------------------------------------------------------------- headers and tasks

STATES = {"O": "In Progress", "F": "Completed"}


def _task_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a task sheet with untidy headers and blank cells."""
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "In Progress").when(F.col("o_orderstatus") == "F", "Completed").otherwise("")
    return o.select(
        F.col("o_orderkey").alias(" Task_ID "),
        F.col("o_orderpriority").alias("Name"),
        state.alias("STATE"),
        F.col("o_custkey").alias("Project"),
        F.col("o_orderdate").alias("Created"),
    )


def tasks_resolved(spark: SparkSession, sf: str) -> DataFrame:
    found = H.resolve_headers(_task_sheet(spark, sf), H.TASK_ALIASES)
    numbered = H.with_row_ids(found, ["id"])
    tidy = numbered.withColumn("createdDate", V.iso_timestamp(F.col("createdDate")))
    return H.with_defaults(tidy, H.TASK_DEFAULTS, "task", "row_no").select(*H.TASK_ALIASES)


TASKS_SQL = """SELECT CASE WHEN o_orderkey = 0 THEN 'task-' || row_number() OVER (ORDER BY o_orderkey) ELSE CAST(o_orderkey AS VARCHAR) END AS id,
o_orderpriority AS title, '' AS description, CASE o_orderstatus WHEN 'O' THEN 'In Progress' WHEN 'F' THEN 'Completed' ELSE 'New' END AS status,
'' AS "assignedTo", CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS "projectId",
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS "createdDate" FROM orders"""


def task_stats(spark: SparkSession, sf: str) -> DataFrame:
    tasks = H.resolve_headers(_task_sheet(spark, sf), H.TASK_ALIASES)
    return tasks.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "In Progress").alias("in_progress"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
    )


TASK_STATS_SQL = """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS in_progress, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders"""


def status_classes(spark: SparkSession, sf: str) -> DataFrame:
    tasks = H.resolve_headers(_task_sheet(spark, sf), H.TASK_ALIASES)
    shown = H.with_defaults(tasks, {"status": "New"})
    css = V.label(F.col("status"), V.STATUS_CLASSES, V.DEFAULT_STATUS_CLASS)
    return shown.groupBy("status", css.alias("css_class")).agg(F.count("*").alias("tasks"))


STATUS_CLASSES_SQL = """SELECT status, CASE status WHEN 'New' THEN 'status-badge status-new' WHEN 'In Progress' THEN 'status-badge status-progress' ELSE 'status-badge status-completed' END AS css_class,
count(*) AS tasks FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'In Progress' WHEN 'F' THEN 'Completed' ELSE 'New' END AS status FROM orders) GROUP BY status"""


def sheet_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as a sheet with two date formats in one column, read back."""
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "F", F.date_format(d, "M/d/yyyy HH:mm:ss")).otherwise(F.date_format(d, "yyyy-MM-dd H:mm:ss"))
    path = work_path(spark, "sheet")
    o.select(F.col("o_orderkey").cast("string").alias("id"), text.alias("createdDate")).write.option("header", True).csv(path)
    sheet = read_sheet(spark, path, ["id", "createdDate"])
    return sheet.select(F.col("id").cast("bigint").alias("id"), V.parse_dates(F.col("createdDate"), SHEET_DATE_FORMATS).alias("created"))


SHEET_DATES_SQL = "SELECT o_orderkey AS id, o_orderdate AS created FROM orders"


def select_by_name(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Key"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Total Price")
    )
    got = H.select_by_name(named, "Select [Order Key], [Total Price]  where [Total Price] > 400000 and [Status] <> '[Status]' ")
    return got.toDF("order_key", "total_price")


SELECT_BY_NAME_SQL = "SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM orders WHERE o_totalprice > 400000"


def update_by_header(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    urgent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    updates = urgent.select(F.col("o_custkey").alias("c_custkey"), F.col("top").alias("c_acctbal"), F.lit("x").alias("unknown"))
    return H.update_by_header(c, "c_custkey", updates)[0]


UPDATE_BY_HEADER_SQL = """SELECT c_custkey, c_name, c_nationkey, coalesce(top, c_acctbal) AS c_acctbal, c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def evolve_schema(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    a, b = H.evolve_schema(s, c)
    return a.unionByName(b)


EVOLVE_SCHEMA_SQL = """SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer"""


def column_letters(spark: SparkSession, sf: str) -> DataFrame:
    i = (F.col("p_partkey") % 18278).cast("int")
    return table(spark, sf, "part").select("p_partkey", V.column_letter(i).alias("letters"))


COLUMN_LETTERS_SQL = """WITH i AS (SELECT p_partkey, CAST(p_partkey % 18278 AS INT) AS n FROM part)
SELECT p_partkey, CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(65 + (n // 26) - 1) || chr(65 + n % 26)
ELSE chr(65 + ((n // 26) - 1) // 26 - 1) || chr(65 + ((n // 26) - 1) % 26) || chr(65 + n % 26) END AS letters FROM i"""


def _new_tasks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "part").select(
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("status"),
        F.col("p_brand").alias("assignedTo"),
        F.col("p_partkey").alias("row_no"),
    )
    sheet = ["ID", "Title", "Status", "assignedTo", "Due", "createdDate"]
    return H.insert_by_header(sheet, rows, now(), F.lit(1737502554802), "row_no")


def inserted_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _new_tasks(spark, sf)[0].toDF("id", "title", "status", "assigned_to", "due", "created_date")


INSERTED_TASKS_SQL = f"""SELECT 'TASK-' || (1737502554802 + p_partkey) AS id, p_name AS title, p_type AS status, p_brand AS assigned_to, '' AS due,
TIMESTAMP '{NOW}' AS created_date FROM part WHERE p_size > 10"""


def rejected_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _new_tasks(spark, sf)[1].select("row_no", "title")


REJECTED_TASKS_SQL = "SELECT p_partkey AS row_no, p_name AS title FROM part WHERE p_size <= 10"


# ---------------------------------------------------------------- upserts and syncs


def _orders_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Open and finished orders are known; a batch names each open and pending order twice."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("uniqueIndicator"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"), "o_orderstatus", "o_orderkey",
    )
    target = o.where(F.col("o_orderstatus").isin("F", "O")).select("uniqueIndicator", "price", "priority")
    twice = o.where(F.col("o_orderstatus").isin("O", "P")).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    urgent = F.col("priority") == "1-URGENT"
    updates = twice.select(
        F.when(F.col("o_orderkey") == 0, F.lit("")).otherwise(F.col("uniqueIndicator")).alias("uniqueIndicator"),
        F.when(urgent, F.col("price")).otherwise(F.col("price") + F.col("version")).alias("price"),
        F.when(~urgent, F.concat(F.lit("v"), F.col("version").cast("string"))).alias("note"),
        F.col("version").alias("batch_no"),
    )
    return S.upsert(target, updates, ["uniqueIndicator"], "batch_no")


def upsert_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_upsert(spark, sf).withColumnRenamed("_action", "action")


UPSERT_CTE = """WITH u AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE o_totalprice + 2 END AS price,
CASE WHEN o_orderpriority <> '1-URGENT' THEN 'v2' END AS note FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey <> 0),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT coalesce(t.k, u.k) AS "uniqueIndicator", CASE WHEN u.k IS NULL THEN t.price ELSE u.price END AS price, t.priority, u.note,
CASE WHEN u.k IS NULL THEN 'kept' WHEN t.k IS NULL THEN 'inserted' WHEN u.price = t.price AND u.note IS NULL THEN 'unchanged' ELSE 'updated' END AS action
FROM t FULL OUTER JOIN u ON t.k = u.k)"""
UPSERT_ORDERS_SQL = UPSERT_CTE + " SELECT * FROM r"


def upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.action_counts(_orders_upsert(spark, sf))


UPSERT_COUNTS_SQL = UPSERT_CTE + " SELECT action, count(*) AS rows FROM r GROUP BY action"


def transaction_keys(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", True)
    amount = F.when(F.col("l_quantity") == 1, "n/a").otherwise(F.format_string("%.2f USD", -F.col("l_extendedprice")))
    key = V.transaction_key(F.date_format("l_shipdate", "yyyy-MM-dd"), amount, F.col("l_returnflag"), F.lit(None).cast("string"))
    return li.select("l_orderkey", "l_linenumber", key.alias("unique_indicator"))


TRANSACTION_KEYS_SQL = """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || '-' || CASE WHEN l_quantity = 1 THEN '0' ELSE
regexp_replace(printf('%.2f', l_extendedprice), '\\.?0+$', '') END || '-' || l_returnflag || '-' AS unique_indicator FROM lineitem"""


def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    pairs = li.select("l_suppkey", "l_partkey", "l_returnflag")
    return S.insert_if_absent(pairs.where("l_returnflag = 'A'"), pairs.where("l_returnflag <> 'A'"), ["l_suppkey", "l_partkey"])


INSERT_IF_ABSENT_SQL = """SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'"""


def get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    types = p.groupBy(F.lower("p_type").alias("keyword")).agg(F.min("p_partkey").alias("first"))
    dim = number_rows(types, ["first"], row_no="keyword_id").select("keyword_id", "keyword")
    asked = p.select("p_partkey", F.explode(F.array(F.concat(F.lit("  "), F.upper("p_name")), F.concat("p_type", F.lit(" ")))).alias("keyword"))
    return S.get_or_create_key(dim, asked, "keyword", "keyword_id", "p_partkey")[1]


GET_OR_CREATE_SQL = """WITH d AS (SELECT lower(p_type) AS name, row_number() OVER (ORDER BY min(p_partkey)) AS id FROM part GROUP BY lower(p_type)),
a AS (SELECT p_partkey, unnest(['  ' || upper(p_name), p_type || ' ']) AS keyword FROM part),
n AS (SELECT lower(trim(keyword)) AS name, min(p_partkey) AS f FROM a WHERE lower(trim(keyword)) NOT IN (SELECT name FROM d) GROUP BY 1),
g AS (SELECT * FROM d UNION ALL SELECT name, (SELECT max(id) FROM d) + row_number() OVER (ORDER BY f, name) FROM n)
SELECT p_partkey, keyword, id AS keyword_id FROM a JOIN g ON g.name = lower(trim(keyword))"""


def slot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Ten poorest customers per nation hold the slots; the twenty richest are put in."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    old = first_k_per_group(c, ["c_nationkey"], ["c_acctbal", "c_custkey"], 10, "slot")
    new = first_k_per_group(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 20, "slot")
    got = S.slot_upsert(
        old.select("c_nationkey", "slot", "c_custkey"), new.select("c_nationkey", "slot", "c_custkey", F.col("c_custkey").alias("seq")),
        ["c_nationkey"], "slot", "seq",
    )
    return got.select("c_nationkey", "slot", "c_custkey", F.col("_action").alias("action"))


SLOT_UPSERT_SQL = """WITH o AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS slot FROM customer QUALIFY slot <= 10),
n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS slot FROM customer QUALIFY slot <= 20)
SELECT coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, CAST(coalesce(n.slot, o.slot) AS INT) AS slot, coalesce(n.c_custkey, o.c_custkey) AS c_custkey,
CASE WHEN n.slot IS NULL THEN 'kept' WHEN o.slot IS NULL THEN 'inserted' WHEN o.c_custkey = n.c_custkey THEN 'unchanged' ELSE 'updated' END AS action
FROM o FULL OUTER JOIN n ON o.c_nationkey = n.c_nationkey AND o.slot = n.slot"""


def latest_text(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select("user_id", F.concat_ws(" ", "event_type", "props").alias("blob"), "event_id")
    target = rows.where("user_id < 50").groupBy("user_id").agg(F.min_by("blob", "event_id").alias("blob"))
    got = S.latest_text_upsert(target, rows, "user_id", "event_id")
    return got.select("user_id", "blob", F.col("_action").alias("action"))


LATEST_TEXT_SQL = """WITH b AS (SELECT user_id, arg_max(event_type || ' ' || props, event_id) AS blob, arg_min(event_type || ' ' || props, event_id) AS old FROM events GROUP BY 1)
SELECT user_id, blob, CASE WHEN user_id >= 50 THEN 'inserted' WHEN blob = old THEN 'unchanged' ELSE 'updated' END AS action FROM b"""


def replace_window(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calendar rows; user 8's calendar is synced at a fixed time."""
    e = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("title"), F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("end"), F.col("user_id").alias("owner"),
    )
    fresh = e.withColumn("title", F.concat(F.lit("new "), "title"))
    got = S.replace_window(e, fresh, F.lit(8), now(), "start", "end", "owner", "event_id", back_days=0)
    return got.select("event_id", "title", "start", "owner", V.duration_hours(F.col("start"), F.col("end")).alias("hours"))


REPLACE_WINDOW_SQL = f"""WITH e AS (SELECT event_id, event_type AS title, ts AS s, ts + to_minutes(CAST(floor(value) AS INT)) AS f, user_id AS owner FROM events),
w AS (SELECT * FROM e WHERE NOT (owner = 8 AND s > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) UNION ALL
SELECT event_id, 'new ' || title, s, f, owner FROM e WHERE owner = 8 AND f > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND s < TIMESTAMP '{NOW}' + INTERVAL 7 DAY)
SELECT event_id, title, s AS start, owner, printf('%.2f', epoch_us(f) / 3600000000.0 - epoch_us(s) / 3600000000.0) AS hours FROM w"""


# The control table of the query (owner, days back, days forward).
WINDOWS = [(8, 0, 0), (3, 2, 1), (5, None, 30), (21, 20, None)]


def replace_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calendar rows; the calendars of four owners are synced, each with its own window."""
    e = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("title"), F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("end"), F.col("user_id").alias("owner"),
    )
    control = spark.createDataFrame(WINDOWS, "owner bigint, back_days int, forward_days int")
    got = S.replace_windows(e, e.withColumn("title", F.concat(F.lit("new "), "title")), control, now(), "start", "end", "owner", "event_id")
    return got.select("event_id", "title", "start", "owner", V.duration_hours(F.col("start"), F.col("end")).alias("hours"))


REPLACE_WINDOWS_SQL = f"""WITH e AS (SELECT event_id, event_type AS title, ts AS s, ts + to_minutes(CAST(floor(value) AS INT)) AS f, user_id AS owner FROM events),
c AS (SELECT owner, TIMESTAMP '{NOW}' - to_days(b) AS low, TIMESTAMP '{NOW}' + to_days(d) AS high FROM (VALUES (8, 7, 7), (3, 2, 1), (5, 7, 30), (21, 20, 7)) v(owner, b, d)),
w AS (SELECT e.* FROM e LEFT JOIN c USING (owner) WHERE NOT coalesce(s > low, false) UNION ALL
SELECT event_id, 'new ' || title, s, f, e.owner FROM e JOIN c USING (owner) WHERE f > low AND s < high)
SELECT event_id, title, s AS start, owner, printf('%.2f', epoch_us(f) / 3600000000.0 - epoch_us(s) / 3600000000.0) AS hours FROM w"""


def touch_last_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Three known owners in slots 0, 1 and 3; today's users try to get in."""
    e = table(spark, sf, "events")
    first = first_rows(e.select("user_id").distinct(), ["user_id"], 3)
    control = first.select(
        F.col("user_id").alias("owner"), F.lit("2023-12-31").cast("timestamp_ntz").alias("stamp"),
        F.when(F.col("user_id") == 2, 3).otherwise(F.col("user_id")).cast("int").alias("slot"),
    )
    today = e.where((F.col("ts") >= now()) & (F.col("ts") < now() + F.expr("INTERVAL 1 DAY"))).select(F.col("user_id").alias("owner"))
    return S.touch_last_sync(control, today, now(), "owner", "stamp", "slot", slots=5)


TOUCH_LAST_SYNC_SQL = f"""WITH c AS (SELECT user_id AS owner, CASE WHEN user_id = 2 THEN 3 ELSE user_id END AS slot FROM (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 3)),
t AS (SELECT DISTINCT user_id AS owner FROM events WHERE ts >= TIMESTAMP '{NOW}' AND ts < TIMESTAMP '{NOW}' + INTERVAL 1 DAY),
n AS (SELECT owner, row_number() OVER (ORDER BY owner) AS r FROM t WHERE owner NOT IN (SELECT owner FROM c))
SELECT owner, CASE WHEN owner IN (SELECT owner FROM t) THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2023-12-31' END AS stamp, CAST(slot AS INT) AS slot FROM c
UNION ALL SELECT owner, TIMESTAMP '{NOW}', CASE r WHEN 1 THEN 2 ELSE 4 END FROM n WHERE r <= 2"""


def ingested_messages(spark: SparkSession, sf: str) -> DataFrame:
    """User messages are known; the batch brings every message through two members."""
    m = table(spark, sf, "conversations").select(
        F.concat(F.lit("spaces/"), "conv_id", F.lit("/messages/"), "turn").alias("message_id"), "role", "text"
    )
    old = m.where("role = 'user'").select("message_id", F.lit("first").alias("member"), "text", F.lit("2024-01-01").cast("timestamp_ntz").alias("touched"))
    batch = m.select("message_id", F.explode(F.array(F.lit("anna"), F.lit("bert"))).alias("member"), "text").withColumn("seq", F.col("member"))
    return S.ingest_new_messages(old, batch.withColumn("touched", F.lit(None).cast("timestamp_ntz")), "message_id", "touched", now(), "seq")


INGESTED_MESSAGES_SQL = f"""SELECT 'spaces/' || conv_id || '/messages/' || turn AS message_id, CASE WHEN role = 'user' THEN 'first' ELSE 'anna' END AS member, text,
TIMESTAMP '{NOW}' AS touched FROM conversations"""

_FOLDERS = {"signup": "INBOX", "error": "A-Notifications", "click": "Auto Complete", "view": "Completed", "purchase": "Archive"}


def mailbox_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that each of the four mailbox runs picks, with their new folder."""
    e = table(spark, sf, "events")
    box = e.select(F.col("event_id").alias("id"), V.label(F.col("event_type"), _FOLDERS).alias("folder"), (F.col("value") > 20).alias("seen"), "ts")
    out = None
    for run in S.MAILBOX_RUNS:
        got = S.mailbox_run(box, run, now(), ["ts", "id"]).where("moved").select(F.lit(run).alias("run"), "id", "folder", "seen")
        out = got if out is None else out.unionByName(got)
    return out


MAILBOX_RUNS_SQL = f"""WITH b AS (SELECT event_id AS id, event_type, value > 20 AS seen, ts FROM events)
SELECT * FROM (SELECT 'complete_month_old' AS run, id, 'Auto Complete' AS folder, true AS seen FROM b WHERE event_type = 'signup' AND ts < TIMESTAMP '{NOW}' - INTERVAL 10 DAY ORDER BY ts, id LIMIT 500)
UNION ALL SELECT * FROM (SELECT 'notifications_complete', id, 'A-Notifications', true FROM b WHERE event_type = 'error' AND NOT seen ORDER BY ts, id LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'auto_complete_complete', id, 'Auto Complete', true FROM b WHERE event_type = 'click' AND NOT seen ORDER BY ts, id LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'completed_to_read', id, 'Completed', true FROM b WHERE event_type = 'view' AND NOT seen AND ts >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY ORDER BY ts, id LIMIT 50)"""


def _status_changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    shift = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(10**9)).otherwise(F.lit(0))
    changes = o.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select(
        (F.col("o_orderkey") + shift).alias("o_orderkey"), F.lit("X").alias("value")
    )
    return S.update_status(o, changes, "o_orderkey", "o_orderstatus", "value")


def update_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status_changes(spark, sf)[0]


UPDATE_STATUS_SQL = """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders"""


def unmatched_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status_changes(spark, sf)[1]


UNMATCHED_STATUS_SQL = "SELECT o_orderkey + 1000000000 AS o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'"


def merge_config(spark: SparkSession, sf: str) -> DataFrame:
    config = table(spark, sf, "customer").select(F.col("c_name").alias("book"), F.lit("N").alias("compare"), F.lit("N").alias("main"))
    edits = table(spark, sf, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("book"), F.lit("Y").alias("compare"), F.lit("N").alias("main"))
    return S.merge_config(config, edits, "book", ["compare", "main"])


MERGE_CONFIG_SQL = """SELECT c_name AS book, CASE WHEN replace(c_name, 'Customer', 'Supplier') IN (SELECT s_name FROM supplier) THEN 'Y' ELSE 'N' END AS compare, 'N' AS main FROM customer"""


# ---------------------------------------------------------------- reshape


def expand_links(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a list of linked ids (part and supplier)."""
    li = table(spark, sf, "lineitem")
    return R.expand_links(li.select(F.col("l_orderkey").alias("order"), F.array("l_partkey", "l_suppkey").alias("links")))


EXPAND_LINKS_SQL = """SELECT l_orderkey || '.' || x AS "orderlinksId", l_orderkey AS "order", x AS "linkId" FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS x FROM lineitem)"""


def flatten_report(spark: SparkSession, sf: str) -> DataFrame:
    """One nested report per order line: a data row, and a section with a data row and a note."""
    shown = F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.format_string("%.2f", F.col("l_extendedprice")).alias("price")
    li = table(spark, sf, "lineitem", True).select("l_orderkey", "l_linenumber", *shown, "l_returnflag", "l_linestatus")
    day, price = F.col("day"), F.col("price")
    cells = lambda *cs: F.array(*[F.struct(c.alias("value")) for c in cs])
    inner = cells(day, F.concat(F.lit("-"), price), F.col("l_returnflag"))
    rows = F.array(*[F.struct(F.lit(t).alias("type"), inner.alias("ColData")) for t in ("Data", "Note")])
    head = F.array(*[F.struct(F.lit(t).alias("ColTitle")) for t in R.REPORT_TITLES])
    top = F.struct(
        F.lit("Data").alias("type"),
        cells(day, price, F.col("l_linestatus"), F.lit("2024-01-01")).alias("ColData"),
        F.lit(None).cast("struct<Row:array<struct<type:string,ColData:array<struct<value:string>>>>>").alias("Rows"),
    )
    section = F.struct(
        F.lit("Section").alias("type"), F.lit(None).cast("array<struct<value:string>>").alias("ColData"), F.struct(rows.alias("Row")).alias("Rows")
    )
    doc = F.to_json(F.struct(F.struct(head.alias("Column")).alias("Columns"), F.struct(F.array(top, section).alias("Row")).alias("Rows")))
    reports = li.select("l_orderkey", "l_linenumber", F.from_json(doc, R.REPORT_SCHEMA).alias("report"))
    flat = R.flatten_report(reports, "report", R.REPORT_TITLES, ["l_orderkey", "l_linenumber"])
    return flat.toDF("l_orderkey", "l_linenumber", "unique_indicator", "date", "amount", "split", "create_date")


FLATTEN_REPORT_SQL = """WITH r AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS d, printf('%.2f', l_extendedprice) AS amount, l_linestatus AS split, '2024-01-01' AS cd FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), '-' || printf('%.2f', l_extendedprice), l_returnflag, '' FROM lineitem)
SELECT l_orderkey, l_linenumber, d || '-' || regexp_replace(ltrim(amount, '-'), '\\.?0+$', '') || '-' || split || '-' || cd AS unique_indicator, d AS date, amount, split, cd AS create_date FROM r"""


def rows_to_array(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    pages = R.rows_to_array(o, ["o_custkey"], ["o_orderkey"], page_rows=5)
    return pages.select("o_custkey", "page_no", "total_rows", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("order_keys"))


ROWS_TO_ARRAY_SQL = """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS total_rows FROM orders)
SELECT o_custkey, (r - 1) // 5 AS page_no, total_rows, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM n GROUP BY 1, 2, 3"""


def payload_json(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    short = R.renamed_payload({"Name": "c_name", "Amount": "c_acctbal"}, "c_custkey")
    return c.select("c_custkey", R.row_payload(c.columns).alias("payload"), short.alias("short_payload"))


PAYLOAD_JSON_SQL = """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' AS payload,
'{"Name":"' || c_name || '","Amount":' || c_acctbal || ',"RowNumber":' || c_custkey || '}' AS short_payload FROM customer"""


def mail_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    template = "Dear {{c_name}}, your balance is {{c_acctbal}} ({{c_mktsegment}}). {{unknown}}"
    return c.select(F.concat(F.lit("Invoice_"), "c_custkey").alias("document"), R.mail_merge(c, template, c.columns).alias("body"))


MAIL_MERGE_SQL = """SELECT 'Invoice_' || c_custkey AS document, 'Dear ' || c_name || ', your balance is ' || c_acctbal || ' (' || c_mktsegment || '). {{unknown}}' AS body FROM customer"""


def split_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    day, clock = V.split_timestamp(F.col("ts"))
    return table(spark, sf, "events").select("event_id", day.alias("sent_date"), clock.alias("sent_time"))


SPLIT_TIMESTAMP_SQL = """SELECT event_id, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS sent_date, strftime(ts - INTERVAL 6 HOUR, '%H:%M:%S') AS sent_time FROM events"""


def json_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as request bodies: some cut short, some without the needed field."""
    e = table(spark, sf, "events")
    body = F.when(F.col("event_type") == "error", F.rtrim(F.col("props"), F.lit("}"))).when(F.col("event_type") == "view", F.lit('{"x": 1}')).when(
        F.col("event_type") == "signup", F.lit("")).otherwise(F.col("props"))
    return parse_payloads(e.select("event_id", body.alias("body")), "body", "k int", ["k"]).select(
        "event_id", F.when(F.col("error").isNull(), F.col("k")).alias("k"), "error"
    )


JSON_PAYLOADS_SQL = """SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(regexp_extract(props, '\\d+', 0) AS INT) END AS k,
CASE event_type WHEN 'error' THEN 'Invalid JSON' WHEN 'view' THEN 'Missing required parameters: k' WHEN 'signup' THEN 'No post data received' END AS error FROM events"""


def search_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.where(X.search_all([F.col(x) for x in c.columns], "mer#0000001"))


SEARCH_SQL = """SELECT * FROM customer WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'mer#0000001')"""


def sorted_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Source sorted by one field, projected and stamped (body of a full refresh), read back."""
    from ..sources.writers import full_refresh, latest_version

    path = work_path(spark, "refresh")
    o = table(spark, sf, "orders")
    full_refresh(o, {"o_orderkey": "id", "o_totalprice": "amount"}, "o_orderkey", now(), path, 1)
    full_refresh(o.where("o_totalprice > 100000"), {"o_orderkey": "id", "o_totalprice": "amount"}, "o_orderkey", now(), path, 2)
    full_refresh(o.where("o_totalprice < 0"), {"o_orderkey": "id", "o_totalprice": "amount"}, "o_orderkey", now(), path, 3)
    return latest_version(spark, path)


SORTED_PROJECTION_SQL = f"SELECT o_orderkey AS id, o_totalprice AS amount, TIMESTAMP '{NOW}' AS synced_at FROM orders WHERE o_totalprice > 100000"


def random_customer(spark: SparkSession, sf: str) -> DataFrame:
    return random_row(table(spark, sf, "customer"), "c_custkey", 42).select("c_custkey", "c_name")


RANDOM_CUSTOMER_SQL = "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '#42'), c_custkey LIMIT 1"


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.build_prompt("Rate this customer.", X.row_to_text(c.columns), "options:good, bad").alias("prompt"))


PROMPT_SQL = """'Rate this customer.' || chr(10) || chr(10) || 'Here are the column-value pairs for the record:' || chr(10) || 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10)
|| 'c_nationkey: ' || c_nationkey || chr(10) || 'c_acctbal: ' || c_acctbal || chr(10) || 'c_mktsegment: ' || c_mktsegment || chr(10) || chr(10) || 'Return exactly one of these values: good, bad.'
|| chr(10) || chr(10) || 'Respond with JSON that matches the required schema exactly.'"""
PROMPTS_SQL = f"SELECT c_custkey, {PROMPT_SQL} AS prompt FROM customer"


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise enrichment with a stand-in for the model: it answers the prompt's length."""
    from ..functions.registry import enrich_rows

    def call(batch):
        return batch.map(lambda p: f'{{"value": "{len(p)}"}}')

    return enrich_rows(table(spark, sf, "customer"), "Rate this customer.", "options:good, bad", call).select("c_custkey", "answer")


ENRICHED_SQL = f"SELECT c_custkey, CAST(length({PROMPT_SQL}) AS VARCHAR) AS answer FROM customer"


_NAMES = (
    "tasks_resolved:TASKS_SQL task_stats:TASK_STATS_SQL status_classes:STATUS_CLASSES_SQL sheet_dates:SHEET_DATES_SQL "
    "select_by_name:SELECT_BY_NAME_SQL update_by_header:UPDATE_BY_HEADER_SQL evolve_schema:EVOLVE_SCHEMA_SQL "
    "column_letters:COLUMN_LETTERS_SQL inserted_tasks:INSERTED_TASKS_SQL rejected_tasks:REJECTED_TASKS_SQL "
    "upsert_orders:UPSERT_ORDERS_SQL upsert_counts:UPSERT_COUNTS_SQL transaction_keys:TRANSACTION_KEYS_SQL "
    "insert_if_absent:INSERT_IF_ABSENT_SQL get_or_create:GET_OR_CREATE_SQL slot_upsert:SLOT_UPSERT_SQL "
    "latest_text:LATEST_TEXT_SQL replace_window:REPLACE_WINDOW_SQL replace_windows:REPLACE_WINDOWS_SQL touch_last_sync:TOUCH_LAST_SYNC_SQL "
    "ingested_messages:INGESTED_MESSAGES_SQL mailbox_runs:MAILBOX_RUNS_SQL update_status:UPDATE_STATUS_SQL "
    "unmatched_status:UNMATCHED_STATUS_SQL merge_config:MERGE_CONFIG_SQL expand_links:EXPAND_LINKS_SQL "
    "flatten_report:FLATTEN_REPORT_SQL rows_to_array:ROWS_TO_ARRAY_SQL payload_json:PAYLOAD_JSON_SQL "
    "mail_merge:MAIL_MERGE_SQL split_timestamp:SPLIT_TIMESTAMP_SQL json_payloads:JSON_PAYLOADS_SQL "
    "search_customers:SEARCH_SQL sorted_projection:SORTED_PROJECTION_SQL random_customer:RANDOM_CUSTOMER_SQL "
    "prompts:PROMPTS_SQL enriched:ENRICHED_SQL"
)
QUERIES = {n: globals()[n] for n in (x.split(":")[0] for x in _NAMES.split())}
ORACLES = {n: globals()[s] for n, s in (x.split(":") for x in _NAMES.split())}
