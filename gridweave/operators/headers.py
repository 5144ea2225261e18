"""Header, schema and projection operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import or_default
from .ordering import number_rows

# Accepted header spellings per logical column, best first.
TASK_ALIASES = {
    "id": ["id", "taskid", "task_id"],
    "title": ["title", "tasktitle", "task_title", "name"],
    "description": ["description", "desc", "task_description"],
    "status": ["status", "taskstatus", "task_status", "state"],
    "assignedTo": ["assignedto", "assigned_to", "assignee", "owner"],
    "projectId": ["projectid", "project_id", "project"],
    "createdDate": ["createddate", "created_date", "date_created", "created"],
}
PROJECT_ALIASES = {
    "id": ["id", "projectid", "project_id"],
    "name": ["name", "projectname", "project_name", "title"],
    "description": ["description", "desc", "project_description"],
    "startDate": ["startdate", "start_date", "started", "begins"],
    "endDate": ["enddate", "end_date", "due_date", "deadline"],
}
USER_ALIASES = {
    "id": ["id", "userid", "user_id"],
    "name": ["name", "username", "user_name", "fullname"],
    "email": ["email", "emailaddress", "email_address", "mail"],
}
TASK_DEFAULTS = {
    "title": "Untitled Task", "description": "", "status": "New", "assignedTo": "", "projectId": "",
}
PROJECT_DEFAULTS = {"name": "Untitled Project", "description": "", "startDate": "", "endDate": ""}
USER_DEFAULTS = {"name": "Unknown User", "email": ""}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_headers(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Keep the logical columns that exist, found by header text in alias order."""
    seen: dict[str, str] = {}
    for name in df.columns:
        seen.setdefault(name.strip().lower(), name)
    chosen = []
    for logical, spellings in aliases.items():
        hit = next((seen[s] for s in spellings if s in seen), None)
        if hit is not None:
            chosen.append(quoted(hit).alias(logical))
    return df.select(*chosen)


def with_defaults(
    df: DataFrame, defaults: dict[str, str | Column], id_prefix: str | None = None, row_no: str | None = None
) -> DataFrame:
    """Blank, null and zero cells become the default; missing columns are added.

    With ``id_prefix`` a blank ``id`` becomes ``<prefix>-<row number>``, read from
    the column ``row_no``.
    """
    spec = dict(defaults)
    if id_prefix:
        spec = {"id": F.concat(F.lit(f"{id_prefix}-"), F.col(row_no).cast("string")), **spec}
    for name, default in spec.items():
        current = quoted(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, or_default(current, default))
    return df


def with_row_ids(df: DataFrame, order: list[str], row_no: str = "row_no") -> DataFrame:
    """Row numbers over a declared order, for generated ids."""
    return number_rows(df, order, row_no=row_no)


def select_by_name(df: DataFrame, query: str) -> DataFrame:
    """``Select [a] where [b] > 5`` with exact header names in brackets.

    Brackets inside quoted text are values and stay; an unknown header raises.
    """
    def name(match: re.Match) -> str:
        if match.group(1) is None:
            return match.group(0)
        if match.group(1) not in df.columns:
            raise ValueError(f"no column named [{match.group(1)}]")
        return "`" + match.group(1).replace("`", "``") + "`"

    text = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\[([^\]]*)\]", name, query).strip()
    head = re.match(r"(?is)^select\s+(.*?)(\s(?:where|group\s+by|order\s+by|limit)\b.*)?$", text)
    if head is None:
        raise ValueError("the query must start with Select")
    return df.sparkSession.sql(f"SELECT {head.group(1)} FROM {{df}} {head.group(2) or ''}", df=df)


def update_by_header(df: DataFrame, key: str, updates: DataFrame) -> tuple[DataFrame, list[str]]:
    """Set the named columns of the rows whose key is in ``updates`` (unique keys).

    Returns the table and the headers that were applied; unknown ones are skipped.
    A null in ``updates`` clears the cell.
    """
    applied = [c for c in updates.columns if c != key and c in df.columns]
    side = updates.select(
        quoted(key), F.struct(*[quoted(c).cast(df.schema[c].dataType).alias(c) for c in applied]).alias("_new")
    )
    joined = df.join(side, key, "left")
    cols = [
        F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(quoted(c)).alias(c) if c in applied else quoted(c)
        for c in df.columns
    ]
    return joined.select(*cols), applied


def evolve_schema(target: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the union of columns: old order first, new ones appended.

    A column that changes type becomes text in both; cells of added columns are null.
    """
    names = list(target.columns) + [c for c in new.columns if c not in target.columns]

    def kind(name: str):
        types = [d.schema[name].dataType for d in (target, new) if name in d.columns]
        return types[0] if len(set(types)) == 1 else "string"

    def widen(df: DataFrame) -> DataFrame:
        return df.select(
            *[(quoted(c) if c in df.columns else F.lit(None)).cast(kind(c)).alias(c) for c in names]
        )

    return widen(target), widen(new)


def require_columns(df: DataFrame, names: list[str], first_only: bool = False) -> DataFrame:
    """Raise when headers are missing, naming all of them or only the first."""
    missing = [n for n in names if n not in df.columns]
    if missing and first_only:
        raise ValueError(f'Missing required column "{missing[0]}"')
    if missing:
        raise ValueError(f"Missing required parameters: {', '.join(missing)}")
    return df


def insert_by_header(
    headers: list[str], rows: DataFrame, now: Column, now_millis: Column, row_no: str
) -> tuple[DataFrame, DataFrame]:
    """New task rows in the sheet's column order, and the rejected rows.

    Rows need a title and a status. Ids are ``TASK-<ms>`` plus the row number, as
    a batch shares one clock. Headers nobody knows get blank cells.
    """
    fillable = {name.lower() for name in TASK_ALIASES} - {"id", "createddate"}
    given = {c.strip().lower(): c for c in rows.columns if c.strip().lower() in fillable}
    filled = [F.coalesce(quoted(given[name]), F.lit("")) != "" for name in ("title", "status")]
    full = rows.withColumn("_ok", filled[0] & filled[1])

    def cell(header: str) -> Column:
        key = header.strip().lower()
        if key == "id":
            value = F.concat(F.lit("TASK-"), (now_millis + F.col(row_no)).cast("string"))
        elif key == "createddate":
            value = now
        elif key in given:
            value = F.coalesce(quoted(given[key]).cast("string"), F.lit(""))
        else:
            value = F.lit("")
        return value.alias(header)

    good = full.where("_ok").select(*[cell(h) for h in headers])
    bad = full.where(~F.col("_ok")).drop("_ok")
    return good, bad
