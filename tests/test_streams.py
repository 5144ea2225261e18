"""Streams over several runs: late and repeated rows, rows without time or key."""

from datetime import datetime

import duckdb
import pytest

from gridweave.plans import ORACLES, QUERIES
from gridweave.streaming import state, triggers
from tools.verify import rows_of


def test_late_and_repeated_triggers(spark, tmp_path):
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    schema = "key string, ts timestamp_ntz, flag string, state string, row int"
    day = lambda d: datetime(2024, 1, d)
    runs = [
        [("k1", day(20), "Trigger", None, 1)],
        [("k2", day(2), "Trigger", None, 2), ("k3", None, "Trigger", "", 3), ("k1", day(20), "Trigger", None, 1)],
        [("k4", day(28), "Trigger", None, 4)],
        [("k1", day(29), "Trigger", None, 1), ("k2", day(30), "Trigger", None, 2), ("k5", day(1), "Trigger", None, 5)],
    ]
    for run in runs:
        spark.createDataFrame(run, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        once = triggers.on_trigger_once(stream, "key", "ts", {"K": "key"}, "row")
        triggers.run_available(once.select("row"), out, out + "-log")
    assert sorted(r["row"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]


def test_changes_of_a_null_key(spark, tmp_path):
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    try:
        for batch in ([(None, "a", 1), (None, "b", 2), ("", "x", 3), ("k", "v", 4)], [(None, "c", 5), ("", "y", 6), (None, "d", 7)]):
            spark.createDataFrame(batch, "cell string, v string, n int").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("cell string, v string, n int").parquet(src)
            triggers.run_available(state.cell_changes(stream, "cell", "v", "n"), out, out + "-log")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert set(map(tuple, spark.read.parquet(out).collect())) == {(None, "b", "d", 7), ("", "x", "y", 6)}


@pytest.mark.parametrize("name", ["cell_change_stream", "appended_payloads"])
def test_events_of_any_time_and_user(spark, tmp_path, name):
    """Events before, within and after January, without a time, and without a user."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i::BIGINT AS event_id, CASE WHEN i % 7 <> 3 THEN TIMESTAMP '2023-11-20' + to_hours(CAST(i AS INT) * 5) END AS ts,
        CASE WHEN i % 5 <> 0 THEN (i % 4)::BIGINT END AS user_id, ['view', 'click', 'error', 'signup'][1 + (i * 11) // 40 % 4] AS event_type FROM range(600) t(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_cell_changes_without_a_place_in_the_order(spark, tmp_path):
    """Rows with a null seq are ignored, also where a key has no others in a batch."""
    src, out, key = str(tmp_path / "s"), str(tmp_path / "o"), "spark.sql.streaming.stateStore.providerClass"
    kinds = "key string, value string, seq long"
    runs = [[("a", "1", 1), ("b", "x", None)], [("a", "2", None), ("b", "y", 5), ("c", None, None)], [("a", "3", 4), ("a", "9", None), ("b", "z", 6)]]
    before = spark.conf.get(key, None)
    spark.conf.set(key, state.ROCKSDB)
    try:
        for run in runs:
            spark.createDataFrame(run, kinds).coalesce(1).write.mode("append").parquet(src)
            changes = state.cell_changes(spark.readStream.schema(kinds).parquet(src), "key", "value", "seq")
            triggers.run_available(changes, out, out + "-log")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", "1", "3", 4), ("b", "y", "z", 6)]


def test_look_back_children(spark, tmp_path):
    """Bounds, nulls, repeated reports, either order of arrival, late rows, and state that shrinks."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from gridweave.streaming.triggers import look_back_children, run_available

    spaces, sent, out = (str(tmp_path / n) for n in ("spaces", "sent", "out"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")

    def at(text):
        return None if text is None else datetime.fromisoformat(f"2024-{text}:00")

    def run(parents, children):
        spark.createDataFrame([(k, at(t)) for k, t in parents], "space string, active timestamp_ntz").write.mode("append").parquet(spaces)
        spark.createDataFrame([(i, k, at(t)) for i, k, t in children], "id int, space string, created timestamp_ntz").write.mode("append").parquet(sent)
        p = spark.readStream.schema("space string, active timestamp_ntz").parquet(spaces)
        c = spark.readStream.schema("id int, space string, created timestamp_ntz").parquet(sent)
        query = run_available(look_back_children(p, c, "space", "active", "created", now), out, out + "_log")
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return sorted(r.id for r in spark.read.parquet(out).collect()), state

    first = [("a", "01-01T00:00"), ("a", "01-01T09:00"), ("b", None), (None, "01-01T05:00")]
    found, before = run(first, [(1, "a", "01-01T00:00"), (2, "a", "01-01T10:00"), (3, "b", "01-01T10:00"), (4, None, "01-01T06:00"), (5, "a", None)])
    assert found == [2]
    assert run([("b", "01-01T12:00")], [(6, "a", "01-01T01:00")])[0] == [2, 3, 6]
    found, after = run([("a", "01-09T00:00")], [(7, "a", "01-09T01:00")])
    assert found == [2, 3, 6, 7]
    assert after <= 9 < before  # one report in each of eight parts, and a message
    assert run([("a", "01-02T01:00")], [(8, "a", "01-02T02:00")])[0] == [2, 3, 6, 7]
