"""Readers: every one takes a path (or a column) and declares its schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import strip_space
from ..operators.reshape import REPORT_SCHEMA

# The two date formats that occur in one sheet column.
SHEET_DATE_FORMATS = ("yyyy-MM-dd H:mm:ss", "M/d/yyyy HH:mm:ss")

_MESSAGES = "messages array<struct<creator:struct<name:string,email:string>,created_date:string,text:string>>"


def read_sheet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header row; all cells are text, as in a sheet."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_report_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested reports, one JSON document per file, as a struct column ``report``."""
    schema = T.StructType.fromDDL(REPORT_SCHEMA[len("struct<"):-1])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.struct("Columns", "Rows").alias("report"))


def read_chat_export(spark: SparkSession, root: str) -> DataFrame:
    """One row per message of an export tree ``<root>/<group folder>/messages.json``."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
    # Folder names are URL-encoded in file paths.
    name = F.try_url_decode(F.regexp_extract(folder, r"([^/]+)$", 1))
    base = spark.read.schema(_MESSAGES).option("multiLine", True).json(f"{root}/*/messages.json")
    rows = base.select(folder.alias("_folder"), name.alias("_name"), F.explode("messages").alias("m"))
    info = (
        spark.read.schema("name string").option("multiLine", True).option("pathGlobFilter", "group_info.json")
        .option("recursiveFileLookup", True).json(root)
        .select(folder.alias("_folder"), F.col("name").alias("_space"))
    )
    kind = F.when(F.contains("_folder", F.lit("DM")), "DM").otherwise("Space")
    joined = rows.join(info, "_folder", "left")
    return joined.select(
        kind.alias("GroupType"),
        F.regexp_extract("_name", r"(\S+)\s*$", 1).alias("GroupId"),
        F.col("m.creator.name").alias("SendersName"),
        F.col("m.creator.email").alias("SendersEmail"),
        F.col("m.created_date").alias("MessageTimestamp"),
        F.col("m.text").alias("MessageContent"),
        F.when(kind == "Space", F.col("_space")).alias("SpaceName"),
    )


def robots_sitemap(content: Column) -> Column:
    """Sitemap url of a robots text: first trimmed line that starts with ``Sitemap:``; else blank."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), strip_space)
    hit = F.get(F.filter(lines, lambda x: x.startswith("Sitemap:")), F.lit(0))
    return F.coalesce(strip_space(F.substring(hit, 9, 2**31 - 1)), F.lit(""))


def read_robots(df: DataFrame, content: str, out: str = "sitemap_url") -> DataFrame:
    return df.withColumn(out, robots_sitemap(F.col(content)))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Every ``url/loc`` of sitemap files."""
    entries = spark.read.format("xml").schema("loc string").option("rowTag", "url").load(path)
    return entries.where(F.col("loc").isNotNull())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (url, status, html); the fetch is not part of this library."""
    return spark.read.parquet(path)


def parse_payloads(df: DataFrame, body: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """JSON bodies as columns; a bad body or a missing field gives an ``error``, never a failed job."""
    parsed = F.from_json(F.col(body), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = df.withColumn("_p", parsed)
    names = required or []
    missing = F.filter(
        F.array(*[F.when(F.col(f"_p.`{n}`").isNull(), F.lit(n)) for n in names]) if names else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    error = (
        F.when(F.coalesce(F.col(body), F.lit("")) == "", "No post data received")
        .when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "Invalid JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("Missing required parameters: "), F.array_join(missing, ", ")))
    )
    fields = [f for f in T.StructType.fromDDL(schema).names]
    return rows.select(*df.columns, *[F.col(f"_p.`{f}`").alias(f) for f in fields], error.alias("error"))


def read_json_payloads(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, streaming: bool = False) -> DataFrame:
    """One payload per line of text files, batch or stream."""
    source = spark.readStream if streaming else spark.read
    return parse_payloads(source.schema("value string").text(path).withColumnRenamed("value", "body"), "body", schema, required)
