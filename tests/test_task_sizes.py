"""What one task holds or sends doesn't grow with the rows."""

import pandas as pd
from pyspark.sql import functions as F

from gridweave.operators import matching as J
from gridweave.operators import pages as P
from gridweave.session import by_rows
from gridweave.streaming import state


def test_mentions_need_no_aggregate_over_all_rows(spark):
    rows = [(i % 500, "Red,, oak ,red" if i % 2 else " oak,zz") for i in range(1000)] + [(None, "red"), (7, "blue"), (8, None), (9, " , ")]
    people = spark.createDataFrame([("dark red oak",), ("Oak tree",), ("blue",), ("",), (None,)], "n string")
    found = J.mention_join(spark.createDataFrame(rows, "id int, listed string"), "id", "listed", people, "n")
    want = {(i, n) for i, t in rows for w in (t or "").split(",") for n in ("dark red oak", "Oak tree", "blue") if w.strip() and w.strip().lower() in n.lower()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert by_rows(spark.range(1000), ["id"], 300).rdd.getNumPartitions() == 4


def test_more_text_means_more_tasks(spark):
    texts = spark.range(400, numPartitions=1).select(F.lit("s").alias("site"), F.repeat(F.lit("word "), 20_000).alias("text"))
    assert "RoundRobinPartitioning(5)" in P.top_keywords(texts, ["site"])._jdf.queryExecution().executedPlan().toString()


def test_a_task_sends_each_key_once(monkeypatch):
    frames = [pd.DataFrame({"key": [f"k{i % 3}" for i in range(10)], "value": [str(b * 10 + i) for i in range(10)], "seq": [b * 10 + i for i in range(10)]}) for b in range(50)]
    assert sorted(map(tuple, pd.concat(state._combine(iter([*frames, frames[0][:0]]))).values)) == [("k0", "499", 499), ("k1", "497", 497), ("k2", "498", 498)]
    monkeypatch.setattr(state, "_HELD", 2)
    assert sum(map(len, state._combine(iter(frames)))) == 150
