"""Reshape operators: expansion, flattening, payloads, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import transaction_key, unfold
from .headers import quoted
from .ordering import number_rows

_CELL = "struct<value:string>"
_ROW = f"struct<type:string,ColData:array<{_CELL}>>"
REPORT_SCHEMA = (
    "struct<Columns:struct<Column:array<struct<ColTitle:string>>>,"
    f"Rows:struct<Row:array<struct<type:string,ColData:array<{_CELL}>,Rows:struct<Row:array<{_ROW}>>>>>>"
)
OUTLINE_SCHEMA = (
    "struct<chapter_number:int,sections:array<struct<section_number:int,summary:string,"
    "characters_present:variant,key_plot_points:variant,setting:string,story_arc_position:string>>>"
)
LINKS_SCHEMA = "array<struct<URL:string,IsExternal:boolean,IsInternal:boolean>>"
# Titles a transaction report must have.
REPORT_TITLES = ["Date", "Amount", "Split", "Create Date"]


def expand_links(df: DataFrame) -> DataFrame:
    """One row per (parent, child) of a table with a scalar and an array column.

    The last array column holds the children, the last other column the parent.
    Empty arrays give no row.
    """
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    scalars = [f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType)]
    if not arrays or not scalars:
        raise ValueError("expand_links needs one array column and one other column")
    child, parent = arrays[-1], scalars[-1]
    rows = df.select(quoted(parent).alias("_p"), F.explode(quoted(child)).alias("_c"))
    both = F.concat(F.col("_p").cast("string"), F.lit("."), F.col("_c").cast("string"))
    return rows.select(
        both.alias(f"{parent}{child}Id"), F.col("_p").alias(parent), F.col("_c").alias(f"{child[:-1]}Id")
    )


def flatten_report(reports: DataFrame, report: str, titles: list[str], keep: list[str] | None = None) -> DataFrame:
    """Data rows of nested reports, and Data rows one level inside sections.

    ``report`` is a column of ``REPORT_SCHEMA``. Cells line up with titles by
    position; missing cells are blank. Each row gets ``uniqueIndicator``. A report
    whose header lacks one of the required titles raises.
    """
    absent = [t for t in REPORT_TITLES if t not in titles]
    if absent:
        raise ValueError(f'Missing required column "{absent[0]}" in JSON data.')
    keep = keep or []
    heads = F.col(f"{report}.Columns.Column.ColTitle")
    if "" in titles:
        heads = F.transform(heads, lambda c: F.coalesce(c, F.lit("")))
    # Plain columns and explodes only: Spark compiles them into one loop, where functions over arrays are interpreted for each report.
    read = reports.select(*keep, heads.alias("_heads"), F.col(f"{report}.Rows.Row").alias("_rows"))
    at = F.array(*[F.array_position("_heads", t).cast("int") for t in titles])
    found = read.select(*keep, at.alias("_at"), "_rows")
    columns: Column = F.col("_at")
    for t in reversed(REPORT_TITLES):
        absent = F.raise_error(F.lit(f'Missing required column "{t}" in JSON data.')).cast("array<int>")
        columns = F.when(F.col("_at")[titles.index(t)] == 0, absent).otherwise(columns)
    top = found.select(*keep, columns.alias("_columns"), F.explode_outer("_rows").alias("_row"))
    alone = F.array(F.struct(F.col("_row.type").alias("type"), F.col("_row.ColData").alias("ColData")))
    below = F.when(F.col("_row.type") == "Data", alone).when(F.col("_row.type") == "Section", F.col("_row.Rows.Row"))
    rows = top.select(*keep, "_columns", F.explode_outer(below).alias("_row")).where(F.col("_row.type") == "Data")
    cells = rows.select(*keep, "_columns", F.col("_row.ColData").alias("_cells"))

    def cell(i: int) -> Column:
        value = F.when(F.col("_columns")[i] > 0, F.get("_cells", F.col("_columns")[i] - 1)["value"])
        return F.coalesce(value, F.lit(""))

    flat = cells.select(*keep, *[cell(i).alias(t) for i, t in enumerate(titles)])
    key = transaction_key(*[quoted(t) for t in REPORT_TITLES])
    return flat.select(*keep, key.alias("uniqueIndicator"), *[quoted(t) for t in titles])


def rows_to_array(df: DataFrame, group: list[str], order: list[str], page_rows: int = 1000) -> DataFrame:
    """Rows of a group as arrays of structs, ``page_rows`` at most in one page.

    Every page also carries the length of the whole array.
    """
    numbered = number_rows(df, order, group, row_no="_no", group_rows="total_rows")
    page = ((F.col("_no") - 1) / page_rows).cast("bigint")
    fields = [quoted(c) for c in df.columns if c not in group]
    return (
        numbered.withColumn("page_no", page)
        .groupBy(*group, "page_no", "total_rows")
        .agg(F.array_sort(F.collect_list(F.struct("_no", F.struct(*fields).alias("_row")))).alias("_rows"))
        .select(*group, "page_no", "total_rows", F.transform("_rows", lambda r: r["_row"]).alias("rows"))
    )


def row_payload(cols: list[str]) -> Column:
    """Header-to-value JSON of a row, blanks kept."""
    return F.to_json(F.struct(*[quoted(c) for c in cols]), {"ignoreNullFields": "false"})


def renamed_payload(names: dict[str, str], row_no: str) -> Column:
    """JSON of chosen columns under new names, plus the row number."""
    fields = [quoted(c).alias(n) for n, c in names.items()]
    return F.to_json(F.struct(*fields, F.col(row_no).alias("RowNumber")), {"ignoreNullFields": "false"})


def links_to_json(col: Column) -> Column:
    return F.to_json(col)


def links_from_json(col: Column) -> Column:
    return F.from_json(col, LINKS_SCHEMA)


def mail_merge(df: DataFrame, template: str, cols: list[str]) -> Column:
    """Template with each ``{{column}}`` replaced by the row's value; other tags stay."""
    out: Column = F.lit(template)
    for c in cols:
        if "{{" + c + "}}" in template:
            out = F.replace(out, F.lit("{{" + c + "}}"), F.coalesce(quoted(c).cast("string"), F.lit("")))
    return out


def explode_sections(outlines: DataFrame, outline: str, order: str | None = None) -> DataFrame:
    """One row per section that has a summary, with a running number over all outlines.

    Sections are numbered by chapter, then by ``order`` (needed when a chapter has
    several outlines), then by their place in the outline.
    """
    extra = [order] if order else []
    def joined(value: Column, separator: str) -> Column:
        parts = F.try_variant_get(value, "$", "array<string>")
        is_list = F.schema_of_variant(value).startswith("ARRAY")
        return F.when(is_list, F.array_join(parts, separator)).otherwise(F.try_variant_get(value, "$", "string"))

    parsed = outlines.select(*extra, F.from_json(F.col(outline), OUTLINE_SCHEMA).alias("o"))
    valid = parsed.where((F.col("o.chapter_number") != 0) & (F.size("o.sections") > 0))
    slim = valid.select(*extra, F.col("o.chapter_number").alias("chapter"), F.col("o.sections").alias("_s"))
    rows = unfold(slim, [*extra, "chapter"], F.col("_s"), "s", "position")
    named = rows.where(F.col("s.summary") != "").select(
        *extra,
        "chapter",
        "position",
        F.col("s.section_number").alias("section"),
        F.col("s.summary").alias("summary"),
        joined(F.col("s.characters_present"), ", ").alias("characters"),
        joined(F.col("s.key_plot_points"), "; ").alias("plot_points"),
        F.col("s.setting").alias("setting"),
        F.col("s.story_arc_position").alias("arc_position"),
    )
    return number_rows(named, ["chapter", *extra, "position"], row_no="sequence").drop("position", *extra)


def character_rows(replies: DataFrame, reply: str, keep: list[str]) -> DataFrame:
    """Character list of a JSON reply as one row per character."""
    schema = "struct<characters:array<struct<name:string,role:string,description:string,motivation:string,arc:string,backstory:string>>>"
    return replies.select(
        *keep, F.posexplode(F.from_json(F.col(reply), schema)["characters"]).alias("_pos", "_c")
    ).select(*keep, (F.col("_pos") + 1).alias("position"), "_c.*")


def flags_to_items(pages: DataFrame, keep: list[str], flags: list[str], status: str | None = None) -> DataFrame:
    """One row per raised flag; pages with status 404 give none."""
    raised = F.filter(
        F.array(*[F.struct(F.lit(f).alias("issue"), quoted(f).alias("flag")) for f in flags]), lambda x: x["flag"] == 1
    )
    rows = pages if status is None else pages.where(F.col(status) != 404)
    return unfold(rows, keep, raised, "_i").select(*keep, F.col("_i.issue").alias("issue"))
