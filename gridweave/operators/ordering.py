"""Row numbers, running totals and neighbours that survive a hot group.

A plain window over a group sorts the whole group in one task. Here the rows of
a group are first split by order ranges; each (group, range) is numbered on its
own, and a small table of counts per (group, range) supplies the offset.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_EXACT = 2.0**53


def _as_number(df: DataFrame, name: str) -> Column | None:
    """Order column as a double that keeps the order; None for text."""
    kind = df.schema[name].dataType.typeName()
    col = F.col(f"`{name}`")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        col = F.unix_micros(col.cast("timestamp"))
    elif kind in ("string", "binary", "boolean", "struct", "array"):
        return None
    return F.coalesce(col.cast("double"), F.lit(float("-inf")))


def split_points(df: DataFrame, number: Column, pieces: int) -> list[float]:
    """About ``pieces - 1`` quantiles, repeated where one value is heavy; a bounded list."""
    finite = df.select(number.alias("_x")).where(F.col("_x") > float("-inf"))
    return list(finite.approxQuantile("_x", [i / pieces for i in range(1, pieces)], 0.5 / pieces) or [])


def _bucket(df: DataFrame, number: Column, cuts: list[float], out: str) -> DataFrame:
    """Index of the range between two cuts (binary search inside Spark)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    split = Bucketizer(splits=splits, inputCol="_x", outputCol=out, handleInvalid="keep")
    return split.transform(df.withColumn("_x", number)).drop("_x").withColumn(out, F.col(out).cast("int"))


def with_pieces(df: DataFrame, order: list[str], pieces: int, out: str = "_piece") -> DataFrame:
    """Add a range number that never decreases along ``order``.

    Ranges come from quantiles of the first order column. A value that alone fills a
    range (a hot chapter, say) is split further by quantiles of the second column.
    """
    lead = _as_number(df, order[0])
    if lead is None:
        raise ValueError("the first order column must be a number or a time")
    cuts = split_points(df, lead, pieces)
    heavy = sorted({c for c in cuts if cuts.count(c) > 1 and abs(c) < _EXACT})
    second = _as_number(df, order[1]) if heavy and len(order) > 1 else None
    if second is None:
        return _bucket(df, lead, sorted(set(cuts)), out)
    alone = sorted(set(cuts) | {math.nextafter(c, math.inf) for c in heavy})
    finer = sorted(set(split_points(df.where(lead.isin(heavy)), second, pieces)))
    both = _bucket(_bucket(df, lead, alone, "_p1"), second, finer, "_p2")
    sub = F.when(lead.isin(heavy), F.col("_p2")).otherwise(F.lit(0))
    return both.withColumn(out, F.col("_p1") * (len(finer) + 2) + sub).drop("_p1", "_p2")


def number_rows(
    df: DataFrame,
    order: list[str],
    group: list[str] | None = None,
    totals: dict[str, str] | None = None,
    row_no: str = "row_no",
    group_rows: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Number rows 1.. within each group (or over the whole table) by ``order``.

    ``order`` must be unique within a group and start with a numeric or time
    column; see :func:`with_pieces`. ``totals`` maps new columns to
    numeric columns whose running sum is wanted; ``group_rows`` names a column
    for the group size.
    """
    totals, group = totals or {}, group or []
    spark = df.sparkSession
    pieces = pieces or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[F.col(f"`{g}`") for g in group]) if group else F.struct(F.lit(0).alias("all"))
    keyed = with_pieces(df, order, pieces).withColumn("_key", key)

    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_sum_{t}") for t, c in totals.items()]
    heads = keyed.groupBy("_key", "_piece").agg(F.count("*").alias("_rows"), *sums)
    # One row per (group, range), so a group has no more rows here than there are ranges.
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    offsets = heads.select(
        "_key",
        "_piece",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_skip"),
        F.sum("_rows").over(whole).alias("_all"),
        *[F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)).alias(f"_skip_{t}") for t in totals],
    )
    local = Window.partitionBy("_key", "_piece").orderBy(*[F.col(f"`{o}`") for o in order])
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = keyed.withColumn("_local", F.row_number().over(local))
    for t, c in totals.items():
        numbered = numbered.withColumn(f"_run_{t}", F.sum(F.coalesce(F.col(c), F.lit(0))).over(running))
    joined = numbered.join(offsets, ["_key", "_piece"])
    out = [F.col(f"`{c}`") for c in df.columns]
    out.append((F.col("_local") + F.col("_skip")).cast("bigint").alias(row_no))
    if group_rows:
        out.append(F.col("_all").cast("bigint").alias(group_rows))
    out += [(F.col(f"_run_{t}") + F.col(f"_skip_{t}")).alias(t) for t in totals]
    return joined.select(*out)


def previous_rows(
    numbered: DataFrame, group: list[str], text: str, count: int, separator: str, out: str, row_no: str = "row_no"
) -> DataFrame:
    """Texts of the last ``count`` non-empty earlier rows of the group, oldest first.

    ``numbered`` comes from :func:`number_rows`. The answer hangs on the number of
    non-empty rows so far (``filled``), so each row meets at most ``count`` others
    by an equi-join on (group, position).
    """
    has_text = F.coalesce(F.col(text) != "", F.lit(False))
    counted = number_rows(
        numbered.withColumn("_filled", has_text.cast("bigint")), [row_no], group, {"_upto": "_filled"}, "_rn"
    ).drop("_rn")
    sources = counted.where(has_text).select(
        *group,
        F.col("_upto").alias("_nth"),
        F.col(text).alias("_text"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.col("_upto") + i)).alias("_slot"),
    )
    recent = sources.groupBy(*group, "_slot").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "_text"))).alias("_texts")
    ).select(*group, "_slot", F.array_join(F.transform("_texts", lambda s: s["_text"]), separator).alias(out))
    asked = counted.withColumn("_slot", F.col("_upto") - F.col("_filled"))
    return asked.join(recent, [*group, "_slot"], "left").drop("_slot", "_upto", "_filled")


def is_last_in_group(row_no: str = "row_no", group_rows: str = "group_rows") -> Column:
    return F.col(row_no) == F.col(group_rows)


def every_nth_or_last(n: int, running_no: str, last: Column) -> Column:
    return (F.col(running_no) % n == 0) | last


def ordered_text(
    numbered: DataFrame, group: list[str], text: Column, separator: str, rows_per_part: int = 1000, row_no: str = "row_no"
) -> DataFrame:
    """Texts of a group in order, one row per part of ``rows_per_part`` rows.

    A normal group is one part; a huge one becomes several cells instead of one
    cell that no task could hold. Concatenating the parts gives the whole text.
    """
    part = ((F.col(row_no) - 1) / rows_per_part).cast("bigint")
    return (
        numbered.select(*group, part.alias("part_no"), F.col(row_no).alias("_no"), text.alias("_text"))
        .groupBy(*group, "part_no")
        .agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("_no", "_text"))).alias("_texts"))
        .select(*group, "part_no", "rows", F.array_join(F.transform("_texts", lambda s: s["_text"]), separator).alias("text"))
    )


def first_k_per_group(df: DataFrame, group: list[str], order: list[Column | str], k: int, row_no: str = "row_no") -> DataFrame:
    """Top-k report per group. Spark cuts each map task to k rows per group before
    the shuffle (WindowGroupLimit), so a hot group ships k rows per task only."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(row_no, F.row_number().over(w)).where(F.col(row_no) <= k)


def first_rows(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """First k rows of the whole table (TakeOrdered: k rows per task)."""
    return df.orderBy(*order).limit(k)


def random_row(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """One repeatable pseudo-random row."""
    pick = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))
    return df.orderBy(pick, id_col).limit(1)


def previous_by_value(df: DataFrame, number: str, text: str, back: int, out: str, group: list[str] | None = None) -> DataFrame:
    """Texts of the rows whose ``number`` is 1..``back`` less, in number order.

    By value, not by row: a gap in the numbers leaves that text out. ``number``
    is unique within the group.
    """
    group = group or []
    sources = df.select(
        *group,
        F.col(number).alias("_from"),
        F.col(text).alias("_text"),
        F.explode(F.sequence(F.col(number) + 1, F.col(number) + back)).alias(number),
    )
    context = sources.groupBy(*group, number).agg(F.array_sort(F.collect_list(F.struct("_from", "_text"))).alias("_c"))
    line = lambda s: F.concat(F.lit("Chapter "), s["_from"].cast("string"), F.lit(": "), s["_text"])
    context = context.select(*group, number, F.array_join(F.transform("_c", line), "\n").alias(out))
    return df.join(context, [*group, number], "left")


def first_last_summary(df: DataFrame, chapter: str, section: str, order: str, summary: str, group: list[str]) -> DataFrame:
    """Section-1 summary of chapter 1 and of the highest chapter, first hit each.

    Two aggregations with map-side combine: the best section-1 row per (group,
    chapter), then the highest chapter per group.
    """
    per_chapter = df.groupBy(*group, chapter).agg(
        F.min_by(
            F.when(F.col(section) == 1, F.col(summary)),
            F.when(F.col(section) == 1, F.col(order)),
        ).alias("_first"),
    )
    return per_chapter.groupBy(*group).agg(
        F.max(F.when(F.col(chapter) == 1, F.col("_first"))).alias("first_summary"),
        F.max_by("_first", F.greatest(F.col(chapter), F.lit(1))).alias("last_summary"),
        F.max(chapter).alias("last_chapter"),
    )
