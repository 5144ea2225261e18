"""Writers. Each writes a new path or appends; nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import sitemap_priority


def sitemap_entries(urls: DataFrame, lastmod: Column) -> DataFrame:
    """``loc, lastmod, changefreq, priority`` of (url, depth); each loc once, at its least depth."""
    best = urls.groupBy(F.col("url").alias("loc")).agg(F.min("depth").alias("depth"))
    return best.select(
        "loc",
        F.date_format(lastmod, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("lastmod"),
        F.lit("daily").alias("changefreq"),
        sitemap_priority(F.col("depth")).alias("priority"),
    )


def write_sitemap(entries: DataFrame, path: str, urls_per_file: int = 50_000) -> None:
    """Sitemap files of at most ``urls_per_file`` urls each (the protocol's own limit)."""
    (
        entries.write.format("xml")
        .option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"')
        .option("rowTag", "url")
        .option("maxRecordsPerFile", urls_per_file)
        .mode("errorifexists")
        .save(path)
    )


def write_group_reports(summary: DataFrame, details: DataFrame, path: str) -> None:
    """Group summary and record details as CSV, group columns first."""
    first = ["Duplicate_Group_ID", "Similarity_Score", "Record_ID"]
    rest = [c for c in details.columns if c not in first]
    summary.write.option("header", True).mode("errorifexists").csv(f"{path}/Duplicate_Groups_Summary")
    details.select(*first, *[F.col(f"`{c}`") for c in rest]).write.option("header", True).mode("errorifexists").csv(
        f"{path}/Duplicate_Details"
    )


def append_rows(df: DataFrame, path: str) -> None:
    """Append at the end; the first write makes the table."""
    df.write.mode("append").parquet(path)


def full_refresh(source: DataFrame, columns: dict[str, str], order: str, now: Column, path: str, version: int) -> int:
    """Write the source sorted, renamed and stamped as a new version of a table.

    No rows: nothing is written, so the last version stays current. Rows are counted
    while they are written. Read the table with :func:`latest_version`.
    """
    if source.limit(1).count() == 0:
        return 0
    seen = Observation("full_refresh")
    rows = source.select(F.col(order).alias("_o"), *[F.col(c).alias(n) for c, n in columns.items()])
    # The hash lets many rows with one sort value spread over several output ranges.
    rows = rows.orderBy("_o", F.xxhash64(*rows.columns)).drop("_o").withColumn("synced_at", now).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return seen.get["rows"]


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of a refreshed table; only its partition is scanned."""
    table = spark.read.parquet(path)
    newest = table.select("version").distinct().agg(F.max("version").alias("v"))
    return table.where(F.col("version") == newest.scalar()).drop("version")


def log_row(spark: SparkSession, now: Column, event: str, details: Column, status: str) -> DataFrame:
    return spark.range(1).select(now.alias("timestamp"), F.lit(event).alias("event"), details.alias("details"), F.lit(status).alias("status"))


def run_log(df: DataFrame, write, path: str, event: str, now: Column) -> DataFrame:
    """Run ``write(df)`` and append one (timestamp, event, details, status) row.

    The row count comes from the write itself, not from a second pass.
    """
    seen = Observation(event)
    spark = df.sparkSession
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        row = log_row(spark, now, event, F.lit(f"{seen.get['rows']} rows"), "Complete")
    except Exception as error:  # the failure itself is logged, then raised again
        append_rows(log_row(spark, now, event, F.lit(type(error).__name__), "Error"), path)
        raise
    append_rows(row, path)
    return row
