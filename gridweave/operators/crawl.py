"""Crawl depth over a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage, work_path
from .ordering import first_k_per_group


def crawl_depth(edges: DataFrame, roots: DataFrame, max_urls: int | None = None, max_rounds: int = 1000) -> DataFrame:
    """Breadth-first depth of every url reachable from its site's roots.

    ``edges`` has site, src, dst; ``roots`` has site, url. Each round joins only the
    newest urls with the edges and appends what it finds as one more part of a table in
    the shared folder, so no url is written twice, plans stay short and lost executors
    do no harm. ``max_urls`` keeps the first urls of a site by (depth, url); None keeps all.
    """
    spark, path = edges.sparkSession, work_path(edges.sparkSession, "crawl")
    links = cut_lineage(edges.select("site", "src", "dst").distinct())
    first = roots.select("site", "url").distinct()
    first.write.parquet(f"{path}/depth=0")
    for depth in range(1, max_rounds + 1):
        newest = spark.read.schema(first.schema).parquet(f"{path}/depth={depth - 1}")
        visited = spark.read.schema(StructType([*first.schema.fields, StructField("depth", IntegerType())])).parquet(path)
        if newest.limit(1).count() == 0:
            break
        reached = newest.withColumnRenamed("url", "src").join(links, ["site", "src"])
        found = reached.select("site", F.col("dst").alias("url")).distinct()
        found.join(visited.select("site", "url"), ["site", "url"], "left_anti").write.parquet(f"{path}/depth={depth}")
    else:
        raise RuntimeError(f"urls are still being found after {max_rounds} rounds")
    if max_urls is None:
        return visited
    return first_k_per_group(visited, ["site"], ["depth", "url"], max_urls, "_no").drop("_no")


def crawl_depth_by_routes(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Depths of up to ``max_depth`` by one recursive query, to check :func:`crawl_depth` on small graphs: it follows every route."""
    query = """WITH RECURSIVE reached(site, url, depth) AS (
        SELECT site, url, 0 FROM {roots}
        UNION ALL
        SELECT e.site, e.dst, r.depth + 1 FROM reached r JOIN {edges} e ON e.site = r.site AND e.src = r.url WHERE r.depth < {most})
        SELECT site, url, min(depth) AS depth FROM reached GROUP BY site, url"""
    return edges.sparkSession.sql(query, roots=roots.select("site", "url").distinct(), edges=edges.select("site", "src", "dst").distinct(), most=max_depth)

