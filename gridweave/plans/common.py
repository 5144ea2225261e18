"""What the query modules share: table access and oracle text fragments."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A test table; ``costly`` rows are spread over all cores when the file is one split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if costly else df


def local_session(app: str, cpus: str | None = None) -> SparkSession:
    """Session of the tests, the bench and the check tool."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# --- fragments of DuckDB SQL for the oracles -------------------------------------------------

URL_RE = (
    r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://(?:([^/?#:@]*)(?::([^/?#@]*))?@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?)?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)


def sql_part(url: str, i: int) -> str:
    return f"regexp_extract({url}, '{URL_RE}', {i})"


def sql_www(host: str) -> str:
    return f"CASE WHEN {host} <> '' AND NOT starts_with({host}, 'www.') THEN 'www.' || {host} ELSE {host} END"


def sql_visible(html: str) -> str:
    return (
        f"regexp_replace({html}, '(?is)<!--.*?(?:-->|\\z)|<script(?:[\\s/][^>]*)?>.*?(?:</script\\s*>|\\z)"
        "|<style(?:[\\s/][^>]*)?>.*?(?:</style\\s*>|\\z)', '', 'g')"
    )


def sql_decode(x: str) -> str:
    """Entities that occur in the test pages."""
    out = x
    for name, ch in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{ch}')"
    return out


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+\z', '', 'g')"


def sql_sanitize(x: str) -> str:
    return rf"""regexp_replace({x}, '[^a-zA-Z0-9$\-_.+!*''(),{{}}|\\^~\[\]`<>#%";/?:@&=]', '', 'g')"""


def sql_dots(path: str) -> str:
    """Dot-segment fold over the parts of a path."""
    folded = (
        f"array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda p: [p]), "
        "lambda acc, p: CASE WHEN p[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] "
        "WHEN p[1] IN ('', '.') THEN acc ELSE list_concat(acc, p) END, CAST([] AS VARCHAR[])), '/')"
    )
    return folded
