"""Site scores from crawl findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

# Weight of one finding per kind, and the population filters.
WEIGHTS = {"issue": 1.0, "warning": 0.2, "notice": 0.1}
MIN_PAGES, MIN_ISSUES, SINCE = 5, 2, "2024-06-05"


def item_counts(items: DataFrame, key: str, types: DataFrame) -> DataFrame:
    """Findings per page and kind; pre-aggregated before any join with pages."""
    typed = items.join(broadcast_if_small(types.select("type_id", "status_name")), "type_id", "left")
    kinds = {"issues": "Issue", "warnings": "Warning", "notices": "Notice", "information": "Information"}
    return typed.groupBy(key).agg(*[F.count_if(F.col("status_name") == k).alias(n) for n, k in kinds.items()])


def crawl_stats(crawls: DataFrame, pages: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Findings per crawl; crawls and pages without findings stay with zeros."""
    names = ["issues", "warnings", "notices", "information"]
    per_crawl = pages.select(key, "crawl_id").join(counts, key).groupBy("crawl_id").agg(*[F.sum(n).alias(n) for n in names])
    joined = crawls.join(per_crawl, "crawl_id", "left")
    return joined.select(*crawls.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def latest_crawls(
    crawls: DataFrame, min_pages: int = MIN_PAGES, min_issues: int = MIN_ISSUES, since: str | None = SINCE
) -> DataFrame:
    """Newest finished, real and large enough crawl of each website."""
    wanted = (
        F.col("complete") & ~F.col("is_test") & (F.col("pages_crawled") > min_pages) & (F.col("issues_found") > min_issues)
    )
    if since is not None:
        wanted = wanted & (F.to_date("crawled_at") > F.lit(since).cast("date"))
    return crawls.where(wanted).groupBy("website").agg(F.max("crawl_id").alias("crawl_id"))


def with_rates(stats: DataFrame) -> DataFrame:
    """Findings per crawled page; null when no page was crawled."""
    return stats.withColumns(
        {f"{k}_rate": F.try_divide(F.col(f"{k}s").cast("double"), F.col("pages_crawled").cast("double")) for k in WEIGHTS}
    )


def min_max_norm(value: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); 0 when the population does not vary."""
    return F.when(high != low, F.try_divide(value - low, high - low)).otherwise(F.lit(0.0))


def site_scores(population: DataFrame, scored: DataFrame) -> DataFrame:
    """Score from 0 (worst of the population) to 100 (best) for each scored crawl.

    Both inputs come from :func:`crawl_stats` (one row per crawl) and are written
    once, as they are read several times. The population's extremes are two one-row
    aggregates used as scalar subqueries, so no row is moved for them. All scores
    equal gives null.
    """
    same = scored is population
    population = cut_lineage(population)
    scored = population if same else cut_lineage(scored)

    def weighted(stats: DataFrame) -> DataFrame:
        limits = with_rates(population).agg(
            F.struct(*[f(f"{k}_rate").alias(f"{n}_{k}") for k in WEIGHTS for n, f in (("min", F.min), ("max", F.max))]).alias("l")
        )
        rated = with_rates(stats).withColumn("_l", limits.scalar())
        total = F.lit(0.0)
        for kind, weight in WEIGHTS.items():
            norm = min_max_norm(F.col(f"{kind}_rate"), F.col(f"_l.min_{kind}"), F.col(f"_l.max_{kind}"))
            total = total + norm * weight
        return rated.withColumn("initial_score", total).drop("_l")

    span = weighted(population).agg(F.struct(F.min("initial_score").alias("low"), F.max("initial_score").alias("high")).alias("s"))
    raw = F.lit(1.0) - F.try_divide(F.col("initial_score") - F.col("_s.low"), F.col("_s.high") - F.col("_s.low"))
    clamped = F.when(raw < 0, 0.0).when(raw > 1, 1.0).otherwise(raw)
    return (
        weighted(scored)
        .withColumn("_s", span.scalar())
        .withColumn("site_score", F.round(clamped * 100, 2))
        .drop("_s")
    )
