"""Record-linkage queries over customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linkage import Duplicates, find_duplicates
from .common import table

CUSTOMER_WEIGHTS = {"c_name": 0.25, "c_mktsegment": 0.25, "n_name": 0.25, "balance": 0.25}
PART_WEIGHTS = {"p_name": 0.5, "p_brand": 0.3, "p_type": 0.2}
CUSTOMER_THRESHOLD, PART_THRESHOLD = 0.8, 0.85


def _customers(spark: SparkSession, sf: str) -> Duplicates:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_mktsegment", "n_name", F.col("c_acctbal").cast("string").alias("balance")
    )
    return find_duplicates(c, "c_custkey", CUSTOMER_WEIGHTS, CUSTOMER_THRESHOLD, record_id="c_custkey")


def _parts(spark: SparkSession, sf: str) -> Duplicates:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return find_duplicates(p, "p_partkey", PART_WEIGHTS, PART_THRESHOLD, record_id="p_partkey")


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence as a fold over rows of the textbook table."""
    hits = f"list_transform(string_split({b}, ''), lambda y: list_transform(string_split({a}, ''), lambda x: CAST(x = y AS INT)))"
    row = (
        "list_reduce(list_transform(range(1, len(old)), lambda j: [CAST(j AS INT)]), "
        "lambda acc, j: list_append(acc, greatest(acc[-1], old[j[1] + 1], old[j[1]] + hit[j[1]])), [0])"
    )
    zeros = f"list_transform(range(length({a}) + 1), lambda z: 0)"
    return f"list_reduce({hits}, lambda old, hit: {row}, {zeros})[-1]"


def _oracle(records: str, weights: dict[str, float], threshold: float) -> str:
    """Record-level pairs, closure and groups, straight from the definition."""
    k = range(len(weights))
    block = " || ".join(f"substr(p{i}, 1, 2)" for i in k)
    vals = " UNION ".join(f"SELECT {i} AS c, x.p{i} AS a, y.p{i} AS b FROM r x JOIN r y ON x.block = y.block AND x.idx < y.idx" for i in k)
    joins = " ".join(f"JOIN ratio r{i} ON r{i}.c = {i} AND r{i}.a = x.p{i} AND r{i}.b = y.p{i}" for i in k)
    sim = "(" + " + ".join(f"r{i}.ratio * {w}::DOUBLE" for i, w in enumerate(weights.values())) + ") / 100"
    return f"""WITH RECURSIVE r0 AS ({records}), r AS (SELECT *, {block} AS block FROM r0),
vals AS ({vals}),
lcs AS (SELECT c, a, b, length(a) + length(b) AS n, CASE WHEN a = b THEN length(a) ELSE {_lcs('a', 'b')} END AS l FROM vals),
ratio AS (SELECT c, a, b, CASE WHEN n = 0 THEN 100.0 ELSE (1.0 - (n - 2 * l)::DOUBLE / n) * 100.0 END AS ratio FROM lcs),
pairs AS (SELECT x.idx AS i, y.idx AS j, x.block, {sim} AS s FROM r x JOIN r y ON x.block = y.block AND x.idx < y.idx {joins}),
e AS (SELECT * FROM pairs WHERE s > {threshold}::DOUBLE),
both_ways AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
walk(node, lab) AS (SELECT i, i FROM both_ways UNION SELECT b.j, w.lab FROM walk w JOIN both_ways b ON w.node = b.i),
comp AS (SELECT node, min(lab) AS c FROM walk GROUP BY node),
firsts AS (SELECT block, min(idx) AS f FROM r GROUP BY block),
g AS (SELECT c, count(*) AS records, row_number() OVER (ORDER BY any_value(f), c) AS group_id FROM comp JOIN r ON r.idx = comp.c JOIN firsts USING (block) GROUP BY c),
g2 AS (SELECT c, (SELECT count(*) FROM comp k WHERE k.c = g.c) AS records, group_id FROM g),
a AS (SELECT c, round(avg(s), 6) AS avg_s FROM e JOIN comp ON comp.node = e.i GROUP BY c)"""


_CUSTOMERS = _oracle(
    "SELECT c_custkey AS idx, lower(trim(c_name)) AS p0, lower(trim(c_mktsegment)) AS p1, lower(trim(n_name)) AS p2, CAST(c_acctbal AS VARCHAR) AS p3 FROM customer JOIN nation ON c_nationkey = n_nationkey",
    CUSTOMER_WEIGHTS, CUSTOMER_THRESHOLD,
)
_PARTS = _oracle(
    "SELECT p_partkey AS idx, lower(trim(p_name)) AS p0, lower(trim(p_brand)) AS p1, lower(trim(p_type)) AS p2 FROM part", PART_WEIGHTS, PART_THRESHOLD
)
_SUMMARY = """ SELECT group_id AS "Duplicate_Group_ID", CAST(0 AS BIGINT) AS "Part", records AS "Number_of_Records", avg_s AS "Average_Similarity",
(SELECT string_agg(CAST(node AS VARCHAR), ', ' ORDER BY node) FROM comp WHERE comp.c = g2.c) AS "Record_IDs" FROM g2 JOIN a USING (c)"""


def _rounded(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.round(col, 6))


def customer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Compared pairs above the threshold (customers have no equal copies)."""
    return _customers(spark, sf).pairs.select("rep_a", "rep_b", F.round("similarity", 9).alias("similarity"))


def customer_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_customers(spark, sf).summary(), "Average_Similarity")


def part_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Parts repeat a lot, so most of their pairs come from folded copies."""
    return _rounded(_parts(spark, sf).summary(), "Average_Similarity")


def part_group_members(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_parts(spark, sf).details(), "Similarity_Score")


QUERIES = {
    "customer_pairs": customer_pairs,
    "customer_groups": customer_groups,
    "part_groups": part_groups,
    "part_group_members": part_group_members,
}
ORACLES = {
    "customer_pairs": _CUSTOMERS + " SELECT i AS rep_a, j AS rep_b, round(s, 9) AS similarity FROM e",
    "customer_groups": _CUSTOMERS + _SUMMARY,
    "part_groups": _PARTS + _SUMMARY,
    "part_group_members": _PARTS + """ SELECT group_id AS "Duplicate_Group_ID", avg_s AS "Similarity_Score", CAST(node AS VARCHAR) AS "Record_ID", p_partkey, p_name, p_brand, p_type
FROM comp JOIN g2 USING (c) JOIN a USING (c) JOIN part ON p_partkey = node""",
}
