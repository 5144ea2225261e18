"""Workbook comparison over long tables of tabs, headers and cells.

Both sides of a comparison are unioned and grouped by position, so each group has
two rows at most and no book or tab can become a hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import column_letter
from ..session import broadcast_if_small

MISSING = "(missing)"
NO_FORMULA = "(no formula)"
_SPREAD = 32
#: Data rows whose mismatches in a column share one list.
PART_ROWS = 10_000


def check_config(config: DataFrame) -> str:
    """The main book's name. Reads three rows at most."""
    mains = config.where(F.col("main") == "Y").limit(2).collect()
    if len(mains) != 1:
        raise ValueError("There must be exactly one Main=Y spreadsheet.")
    if mains[0]["compare"] != "Y":
        raise ValueError("Your main spreadsheet must also have Compare=Y.")
    book = mains[0]["book"]
    if not config.where((F.col("compare") == "Y") & (F.col("book") != book)).limit(1).count():
        raise ValueError("No other spreadsheets selected for comparison.")
    return book


def table_diff(tables: DataFrame, headers: DataFrame, cells: DataFrame, config: DataFrame, first_rows: int | None = 5) -> DataFrame:
    """Discrepancies of every compared book against the main one.

    ``cells.row_no`` counts data rows from 1; only the first ``first_rows`` are
    compared (all when it is None), and only cells that start with ``=`` on either side.
    A column's mismatches come in parts of :data:`PART_ROWS` data rows, one row each; the
    headers are in the column's first row.
    """
    main = check_config(config)
    books = broadcast_if_small(config.where((F.col("compare") == "Y") & (F.col("book") != main)).select("book"))
    theirs = tables.join(books, "book", "left_semi").select("book", "tab")
    main_tabs = tables.where(F.col("book") == main).select("tab").distinct()

    # Every book should have every main tab; tabs are spread over buckets to pair them up.
    expected = books.select("book", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("_b")).join(
        main_tabs.withColumn("_b", F.pmod(F.hash("tab"), F.lit(_SPREAD))), "_b"
    ).select("book", "tab")
    missing = expected.join(theirs, ["book", "tab"], "left_anti").withColumn("type", F.lit("missingTab"))
    extra = theirs.join(main_tabs, "tab", "left_anti").select("book", "tab").withColumn("type", F.lit("extraTab"))
    shared = expected.join(theirs, ["book", "tab"], "left_semi")

    def sided(df: DataFrame, position: list[str], value: str) -> DataFrame:
        own = df.where(F.col("book") == main).drop("book").join(shared, "tab")
        other = df.join(shared, ["book", "tab"], "left_semi")
        cols = ["book", "tab", *position]
        both = own.select(*cols, F.col(value).alias("m"), F.lit(None).cast("string").alias("o")).unionByName(
            other.select(*cols, F.lit(None).cast("string").alias("m"), F.col(value).alias("o"))
        )
        return both.groupBy(*cols).agg(F.max("m").alias("m"), F.max("o").alias("o"))

    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(MISSING))
    head = sided(headers, ["col_idx"], "header").select("book", "tab", "col_idx", named("m").alias("m"), named("o").alias("o"))
    head = head.where("m <> o").select(
        "book", "tab", "col_idx", F.col("m").alias("main_header"), F.col("o").alias("other_header"), F.lit(None).alias("cell")
    )
    formulas = cells.where(F.col("cell").startswith("="))
    formulas = formulas if first_rows is None else formulas.where(F.col("row_no") <= first_rows)
    cell = sided(formulas, ["row_no", "col_idx"], "cell").where(~F.col("m").eqNullSafe(F.col("o")))
    shown = lambda c: F.coalesce(F.col(c), F.lit(NO_FORMULA))
    found = F.struct((F.col("row_no") + 1).alias("row_number"), shown("m").alias("main_formula"), shown("o").alias("other_formula"))
    part = F.floor((F.col("row_no") - 1) / PART_ROWS).alias("_part")
    cell = cell.select(
        "book", "tab", "col_idx", part, F.lit(None).cast("string").alias("main_header"), F.lit(None).cast("string").alias("other_header"), found.alias("cell")
    )
    # At most PART_ROWS cells per list, so it stays short.
    columns = head.withColumn("_part", F.lit(0).cast("bigint")).withColumn("cell", F.lit(None).cast(cell.schema["cell"].dataType)).unionByName(cell)
    columns = columns.groupBy("book", "tab", "col_idx", "_part").agg(
        F.max("main_header").alias("main_header"),
        F.max("other_header").alias("other_header"),
        F.array_sort(F.collect_list("cell")).alias("formula_mismatches"),
    ).withColumn("type", F.lit("columnGroup")).withColumn("column_letter", column_letter(F.col("col_idx"))).drop("col_idx", "_part")
    out = columns.unionByName(missing, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)
    issues = F.when(F.col("main_header").isNotNull(), 1).otherwise(0) + F.coalesce(F.size("formula_mismatches"), F.lit(0))
    return out.select(
        "book", "tab", "type", "column_letter", "main_header", "other_header", "formula_mismatches",
        F.when(F.col("type") == "columnGroup", issues).otherwise(1).alias("issues"),
    )


def discrepancy_rollup(diff: DataFrame) -> DataFrame:
    """Discrepancies and issues per book, per tab and per column (nulls are totals); a column in parts counts once."""
    whole = diff.groupBy("book", "tab", "type", "column_letter").agg(
        F.when(F.col("type") == "columnGroup", 1).otherwise(F.count("*")).alias("found"), F.sum("issues").alias("issues")
    )
    return whole.rollup("book", "tab", "column_letter").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("found").cast("bigint").alias("discrepancies"),
        F.sum("issues").cast("bigint").alias("issues"),
    ).where((F.col("level") != 7))
