"""Sources, sinks, streams, generators and registered functions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridweave import generators, session
from gridweave.functions import registry
from gridweave.functions.values import parse_dates
from gridweave.operators import headers as H
from gridweave.sources import readers as Rd
from gridweave.sources import writers as Wr
from gridweave.streaming import ingest, state, triggers

TASKS = """id,title,description,status,assignedTo,projectId,createdDate
T001,Plan,"First, plan.",In Progress,U001,P001,2023-10-01 10:00:00
T002,Build,Then build.,Open,U002,P001,2023-10-02 8:00:00
T003,Ship,"Say ""done"".",Completed,U003,P002,1/21/2025 17:35:55
"""


def test_read_sheet(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TASKS)
    df = H.resolve_headers(Rd.read_sheet(spark, str(tmp_path / "t.csv")), H.TASK_ALIASES)
    got = df.select("id", "description", parse_dates(F.col("createdDate"), Rd.SHEET_DATE_FORMATS).alias("d")).orderBy("id").collect()
    assert [r["description"] for r in got] == ["First, plan.", "Then build.", 'Say "done".']
    assert got[1]["d"] == datetime(2023, 10, 2, 8) and got[2]["d"] == datetime(2025, 1, 21, 17, 35, 55)
    counts = {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    assert counts == {"In Progress": 1, "Open": 1, "Completed": 1}


def test_report_file(spark, tmp_path):
    cells = lambda *v: [{"value": x} for x in v]
    report = {
        "Columns": {"Column": [{"ColTitle": t} for t in ("Date", "Memo", "Amount", "Split", "Create Date")]},
        "Rows": {"Row": [
            {"type": "Data", "ColData": cells("2025-02-11", "m", "-100.50", "", "2025-01-01")},
            {"type": "Section", "Rows": {"Row": [{"type": "Data", "ColData": cells("2025-03-01")}, {"type": "Section", "ColData": cells("deep")}]}},
            {"type": "Section"}, {"type": "Summary", "ColData": cells("total")},
        ]},
    }
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    from gridweave.operators.reshape import flatten_report

    df = flatten_report(Rd.read_report_json(spark, str(tmp_path / "r.json")), "report", ["Date", "Amount", "Split", "Create Date", "Memo"])
    assert sorted(tuple(r) for r in df.collect()) == [
        ("2025-02-11-100.5--2025-01-01", "2025-02-11", "-100.50", "", "2025-01-01", "m"), ("2025-03-01-0--", "2025-03-01", "", "", "", ""),
    ]


def test_chat_export(spark, tmp_path):
    def put(folder, messages, info=None):
        d = tmp_path / folder
        d.mkdir()
        (d / "messages.json").write_text(json.dumps({"messages": messages}, indent=1))
        if info is not None:
            (d / "group_info.json").write_text(json.dumps(info))

    m = lambda t: {"creator": {"name": "N", "email": "e@x.y"}, "created_date": "Monday", "text": t}
    put("Space AAA", [m("one"), m("two")], {"name": "Team"})
    put("DM BBB", [m("three")], {"name": "hidden"})
    put("Space CCC", [{"creator": {"name": "N"}}])
    got = sorted((tuple(r) for r in Rd.read_chat_export(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([
        ("Space", "AAA", "N", "e@x.y", "Monday", "one", "Team"), ("Space", "AAA", "N", "e@x.y", "Monday", "two", "Team"),
        ("DM", "BBB", "N", "e@x.y", "Monday", "three", None), ("Space", "CCC", "N", None, None, None, None),
    ], key=str)


@pytest.mark.parametrize("text, want", [("User-agent: *\n  Sitemap:  https://x/s.xml \nSitemap: b", "https://x/s.xml"), ("sitemap: x", ""), ("", ""), (None, ""), ("Sitemap:a\r\n", "a")])
def test_robots(value, text, want):
    assert value(Rd.robots_sitemap, text) == want


def test_sitemap_round_trip(spark, tmp_path):
    urls = spark.createDataFrame([("https://www.x.com", 0), ("https://www.x.com/a&b", 1), ("https://www.x.com/a&b", 3)], "url string, depth int")
    entries = Wr.sitemap_entries(urls, F.lit("2024-01-20 01:02:03").cast("timestamp_ntz"))
    Wr.write_sitemap(entries, str(tmp_path / "map"))
    back = Rd.read_sitemap(spark, str(tmp_path / "map"))
    assert sorted(r["loc"] for r in back.collect()) == ["https://www.x.com", "https://www.x.com/a&b"]
    text = "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    assert "<priority>0.8228</priority>" in text and "<lastmod>2024-01-20T01:02:03+00:00</lastmod>" in text and "urlset xmlns=" in text


def test_payload_errors(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"b": "x"}',), ("{oops",), ("",), (None,)], "body string")
    got = [r["error"] for r in Rd.parse_payloads(df, "body", "a int, b string", ["a"]).collect()]
    assert got == [None, "Missing required parameters: a", "Invalid JSON", "No post data received", "No post data received"]


def test_refresh_and_logs(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    src = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    assert Wr.full_refresh(src, {"name": "Name"}, "id", now, path, 1) == 2
    assert Wr.full_refresh(src.limit(1), {"name": "Name"}, "id", now, path, 2) == 1
    assert Wr.full_refresh(src.where("id > 9"), {"name": "Name"}, "id", now, path, 3) == 0
    assert Wr.latest_version(spark, path).count() == 1
    Wr.run_log(src, lambda d: Wr.append_rows(d, str(tmp_path / "out")), log, "append", now)
    Wr.run_log(src, lambda d: Wr.append_rows(d, str(tmp_path / "out")), log, "append", now)
    with pytest.raises(ZeroDivisionError):
        Wr.run_log(src, lambda d: 1 / 0, log, "bad", now)
    assert sorted((r["event"], r["details"], r["status"]) for r in spark.read.parquet(log).collect()) == [
        ("append", "2 rows", "Complete"), ("append", "2 rows", "Complete"), ("bad", "ZeroDivisionError", "Error"),
    ]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_group_reports(spark, tmp_path):
    from gridweave.operators.linkage import find_duplicates

    df = spark.createDataFrame([(1, "anna"), (2, "anna"), (3, "zoe")], "idx int, name string")
    found = find_duplicates(df, "idx", {"name": 1.0}, record_id="idx")
    Wr.write_group_reports(found.summary(), found.details(), str(tmp_path / "out"))
    back = Rd.read_sheet(spark, str(tmp_path / "out/Duplicate_Details"))
    assert back.columns == ["Duplicate_Group_ID", "Similarity_Score", "Record_ID", "idx", "name"] and back.count() == 2
    assert Rd.read_sheet(spark, str(tmp_path / "out/Duplicate_Groups_Summary")).first()["Record_IDs"] == "1, 2"


# ------------------------------------------------------------------ streams


def message_files(spark, folder, batches):
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "id string, text string, seq int").coalesce(1).write.mode("append").parquet(f"{folder}/n={n}")


def test_ingest_same_for_one_and_many_batches(spark, tmp_path):
    batches = [[("a", "1", 1), ("a", "2", 2)], [("a", "3", 3), ("b", "4", 4)], [("c", "5", 5)]]
    got = []
    for name, per_batch in (("one", 100), ("many", 1)):
        src, out = str(tmp_path / f"src-{name}"), str(tmp_path / f"out-{name}")
        message_files(spark, src, batches)
        stream = spark.readStream.schema("id string, text string, seq int").option("maxFilesPerTrigger", per_batch).parquet(f"{src}/*")
        for _ in range(2):  # a second run finds nothing new
            ingest.ingest_stream(stream, out, out + "-log", "id", "seq", F.lit("2024-01-20").cast("timestamp_ntz"))
        got.append(sorted((r["id"], r["text"]) for r in ingest.ingested_messages(spark, out, "id", "seq", "touched").collect()))
    assert got[0] == got[1] == [("a", "1"), ("b", "4"), ("c", "5")]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    message_files(spark, src, [[("a", "1", 1)], [("b", "2", 2)]])
    stream = spark.readStream.schema("id string, text string, seq int").parquet(f"{src}/*")
    stamp = F.lit("2024-01-20").cast("timestamp_ntz")
    ingest.ingest_stream(stream, out, str(tmp_path / "log1"), "id", "seq", stamp)
    before = sorted(map(tuple, ingest.ingested_messages(spark, out, "id", "seq", "touched").collect()))
    ingest.ingest_stream(stream, out, str(tmp_path / "log2"), "id", "seq", stamp)  # lost checkpoint: same batch ids again
    assert sorted(map(tuple, ingest.ingested_messages(spark, out, "id", "seq", "touched").collect())) == before


def test_triggers_on_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    t = datetime(2024, 1, 20)
    spark.createDataFrame(
        [("Tasks", "Status", "Completed", 1), ("Tasks", "Status", "Open", 2), ("Tasks", "Title", "Completed", 3), ("Other", "Status", "Completed", 4)],
        "table string, column string, new_value string, row int").write.parquet(src + "/e")
    stream = spark.readStream.schema("table string, column string, new_value string, row int").parquet(src + "/e")
    out = str(tmp_path / "out")
    triggers.webhook_outbox(triggers.on_status(stream, ["row", "new_value"]).select("payload"), out, out + "-log")
    assert [r["payload"] for r in spark.read.parquet(out).collect()] == ['{"row":1,"new_value":"Completed"}']

    rows = [("k1", t, "Trigger", None, 1), ("k1", t, "Trigger", "", 1), ("k2", t, "Trigger", "Processed", 2), ("k3", t, "", None, 3)]
    schema = "key string, ts timestamp_ntz, flag string, state string, row int"
    spark.createDataFrame(rows, schema).write.parquet(src + "/f")
    once = triggers.on_trigger_once(spark.readStream.schema(schema).parquet(src + "/f"), "key", "ts", {"K": "key"}, "row")
    out2 = str(tmp_path / "out2")
    triggers.run_available(once.select("payload"), out2, out2 + "-log")
    assert [r["payload"] for r in spark.read.parquet(out2).collect()] == ['{"K":"k1","RowNumber":1}']


def test_look_back_bounds(spark):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    df = spark.createDataFrame([(1, datetime(2024, 1, 19)), (2, datetime(2024, 1, 19, 0, 0, 1))], "id int, ts timestamp_ntz")
    assert [r["id"] for r in triggers.look_back(df, "ts", now).collect()] == [2]
    assert sorted(r["id"] for r in triggers.look_back(df, "ts", now, inclusive=True).collect()) == [1, 2]
    assert triggers.late_limit(df, "ts", 24).count() == 2


def test_changed_cells_and_state(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", 7), (2, "b", 6), (3, "c", 1)], "id int, x string, y int")
    assert sorted(map(tuple, state.changed_cells(old, new, ["id"], ["x", "y"]).collect())) == [(1, "y", "5", "7"), (2, "x", None, "b")]

    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    try:
        for n, batch in enumerate([[("r1", "a", 1), ("r1", "b", 2), ("r2", "x", 3)], [("r1", "b", 4), ("r2", "y", 5)], [("r1", "c", 6), ("r2", "old", 0)]]):
            spark.createDataFrame(batch, "cell string, v string, n int").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("cell string, v string, n int").parquet(src)
            triggers.run_available(state.cell_changes(stream, "cell", "v", "n"), out, out + "-log")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("r1", "b", "c", 6), ("r2", "x", "y", 5)]


# ------------------------------------------------------------------ generators, functions, session


def test_mock_contacts(spark):
    a, b = generators.mock_contacts(spark, 50, 1).collect(), generators.mock_contacts(spark, 50, 1).collect()
    assert a == b != generators.mock_contacts(spark, 50, 2).collect()
    assert a[0].asDict().keys() == {"First Name", "Last Name", "Phone Number", "Email", "Website"}
    assert all(len(r["Phone Number"]) == 12 for r in a)


def test_registered_functions(spark):
    assert "gw_email" in registry.register_functions(spark)
    row = spark.sql("SELECT gw_word_count(' a  b ') w, gw_column_letter(27) l, gw_common_subsequence('abc', 'axc') c, gw_valid_email('a@b.c') v").first()
    assert tuple(row) == (2, "AB", 2, True)


def test_enrich_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    seen = registry.enrich_rows(df, "Do it.", "number", lambda p: p.str.count("name: x").map(lambda n: f'{{"value": {n}}}'))
    assert sorted(map(tuple, seen.collect())) == [(1, "x", "1"), (2, None, "0")]


def test_membership(spark):
    from gridweave.operators.matching import membership_fanout

    t = datetime(2024, 1, 2)
    spaces = spark.createDataFrame([("spaces/A", "Team", t), ("spaces/B", "", t), ("spaces/C", "x", datetime(2023, 1, 1))], "name string, display_name string, last_active timestamp_ntz")
    members = spark.createDataFrame([("spaces/A", "users/1", "HUMAN"), ("spaces/B", "users/1", "HUMAN"), ("spaces/B", "users/2", "HUMAN"), ("spaces/A", "users/3", "BOT"), ("spaces/C", "users/1", "HUMAN")], "space string, member string, member_type string")
    users = spark.createDataFrame([("1", "a@b.c"), ("2", "bad"), ("3", "x@y.z")], "user_id string, email string")
    got = membership_fanout(spaces, members, users, F.lit("2024-01-02").cast("timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == [("A", "Team", "1", "a@b.c"), ("B", "Unnamed Space", "1", "a@b.c")]


def test_sizes_and_folders(spark):
    df = spark.range(100)
    assert session.is_small(df, 100) and not session.is_small(df, 99) and not session.is_small(df, 100, max_bytes=10)
    assert session.work_path(spark, "a") != session.work_path(spark, "a")
    assert session.work_path(spark, "a").startswith(session.shared_folder(spark))
    assert session.spread(spark.range(4, numPartitions=1)).rdd.getNumPartitions() >= 2
    wide = spark.range(4, numPartitions=50)
    assert session.spread(wide) is wide
    cut = session.cut_lineage(df.selectExpr("id", "array(id) AS a"))
    assert cut.count() == 100 and cut.schema["a"].dataType.simpleString() == "array<bigint>"


def test_column_letters_agree(spark):
    from gridweave.functions import values as V
    from gridweave.functions.registry import register_functions
    from pyspark.sql import functions as F

    register_functions(spark)
    rows = spark.range(0, 18_278).select(V.column_letter(F.col("id").cast("int")).alias("a"), F.expr("gw_column_letter(cast(id AS int))").alias("b"))
    assert rows.where("a <> b OR a IS NULL").count() == 0
