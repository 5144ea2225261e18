"""Every registered query against its SQL counterpart, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from gridweave.plans import ORACLES, QUERIES  # noqa: E402
from tools.verify import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "site_score" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, cols = rows_of(df.columns, df.collect())
    cur = duck.execute(ORACLES[name])
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == wcols and got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name, pushed",
    [("select_by_name", "GreaterThan(o_totalprice,400000.0)"), ("insert_if_absent", "EqualTo(l_returnflag,A)")],
)
def test_filters_reach_the_scan(spark, name, pushed):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan
    assert "o_custkey" not in plan and "l_shipdate" not in plan


def test_link_rows_do_not_carry_the_page(spark):
    plan = QUERIES["page_links"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    assert "html#" not in generate and "_m#" not in generate.split("), [")[-1]


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = QUERIES["site_keywords"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 15, Partial" in plan


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    """A copy without their folders imports, with or without the pipeline's file, and offers all other queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "gridweave", tmp_path / "gridweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names, oracles = said.stdout.splitlines()
    assert names.split() == sorted(QUERIES) and oracles.split() == sorted(ORACLES)
