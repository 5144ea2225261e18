"""Operators without their reference's limits, against the oracles without theirs."""

from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gridweave.operators import diff as D
from gridweave.operators import sync as S
from gridweave.plans import sections, sheets
from gridweave.plans.common import table
from tools.verify import TABLES, rows_of

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def oracle(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


@here
@pytest.mark.parametrize("part_rows", [10_000, 7])
def test_diff_of_all_rows(spark, monkeypatch, part_rows):
    """Every formula of every row; lists in parts hold the same cells, and the rollup counts a column once."""
    monkeypatch.setattr(D, "PART_ROWS", part_rows)
    monkeypatch.setattr(sections, "_diff", lambda spark, sf: D.table_diff(*sections._books(spark, sf), first_rows=None))
    diff = sections.workbook_diff(spark, SF)
    parts = diff.groupBy("book", "tab", "type", "column_letter").agg(
        F.max("main_header").alias("main_header"), F.max("other_header").alias("other_header"), F.sum("issues").alias("issues"),
        F.collect_list(F.struct(F.split_part("cells", F.lit("|"), F.lit(1)).try_cast("int").alias("n"), "cells")).alias("p"))
    whole = parts.withColumn("cells", F.array_join(F.filter(F.transform(F.array_sort("p"), lambda x: x["cells"]), lambda x: x != ""), ";")).drop("p")
    assert diff.count() > whole.count() if part_rows == 7 else diff.count() == whole.count()
    every = sections.WORKBOOK_DIFF_SQL.replace(" QUALIFY r <= 5", "")
    assert rows_of(whole.columns, whole.collect()) == oracle(every)
    rolled = sections.diff_rollup(spark, SF)
    assert rows_of(rolled.columns, rolled.collect()) == oracle(sections.DIFF_ROLLUP_SQL.replace(" QUALIFY r <= 5", ""))


def test_every_owner_gets_a_slot(spark):
    t0, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    control = spark.createDataFrame([("a", t0, 0), ("b", t0, 2)], "owner string, stamp timestamp_ntz, slot int")
    owners = spark.createDataFrame([(x,) for x in "bcdefg"], "owner string")
    run = lambda **k: S.touch_last_sync(control, owners, F.lit(now), "owner", "stamp", "slot", **k)
    got = run(slots=None)
    assert sorted((r["owner"], r["slot"]) for r in got.collect()) == [("a", 0), ("b", 2), ("c", 1), ("d", 3), ("e", 4), ("f", 5), ("g", 6)]
    assert S.without_slot(owners, got, "owner").count() == 0
    assert sorted(r["owner"] for r in S.without_slot(owners, run(), "owner").collect()) == ["f", "g"]


@here
def test_mailbox_without_limits(spark):
    e = table(spark, SF, "events")
    box = e.select(F.col("event_id").alias("id"), sheets.V.label(F.col("event_type"), sheets._FOLDERS).alias("folder"), (F.col("value") > 20).alias("seen"), "ts")
    got = []
    for run in S.MAILBOX_RUNS:
        moved = S.mailbox_run(box, run, sheets.now(), ["ts", "id"], limit=None).where("moved")
        got += [(run, r["id"], r["folder"], r["seen"]) for r in moved.collect()]
    want = sheets.MAILBOX_RUNS_SQL
    for n in (500, 100, 50):
        want = want.replace(f" LIMIT {n}", "")
    want = oracle(want)
    assert rows_of(["run", "id", "folder", "seen"], got) == want and len(got) > 100
