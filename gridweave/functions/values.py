"""Cell-level expressions: numbers, dates, labels, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status labels shown for task states and their display classes.
STATUS_CLASSES = {
    "New": "status-badge status-new",
    "In Progress": "status-badge status-progress",
    "Completed": "status-badge status-completed",
}
DEFAULT_STATUS_CLASS = "status-badge"

# Log states and their display colours.
LOG_COLOURS = {
    "Error": "#f4cccc",
    "Warning": "#fce5cd",
    "Complete": "#d9ead3",
    "Processing": "#d0e0e3",
}

# Fixed pattern: the numeric prefix that a lenient float parser accepts.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
UNSIGNED_PREFIX = r"^\s*[+-]?((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def unfold(df: DataFrame, keep: list[str], array: Column, out: str, position: str | None = None) -> DataFrame:
    """One row per array element, none for an empty array, the array computed once.

    For a plain explode Spark adds a filter on the array's size and moves it down,
    where it computes the array a second time; an outer explode gets no such filter.
    """
    rows = df.select(*keep, array.alias("_array")).select(*keep, F.posexplode_outer("_array").alias("_at", out))
    rows = rows.where(F.col("_at").isNotNull())
    return rows.withColumnRenamed("_at", position) if position else rows.drop("_at")


def or_default(col: Column, default) -> Column:
    """``col`` unless it is null, blank or zero; then ``default``."""
    value = default if isinstance(default, Column) else F.lit(default)
    text = col.cast("string")
    empty = col.isNull() | (text == "") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.when(empty, value.cast("string")).otherwise(text)


def first_text(*cols: Column) -> Column:
    """First argument that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def resource_id(col: Column) -> Column:
    """The part after the first slash of names such as ``spaces/AAA``."""
    return F.split_part(col, F.lit("/"), F.lit(2))


def lenient_amount(col: Column) -> Column:
    """Decimal value of the leading number in a text; 0 when there is none."""
    prefix = F.nullif(F.regexp_extract(col, NUMBER_PREFIX, 1), F.lit(""))
    return F.coalesce(prefix.try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))


def number_text(col: Column) -> Column:
    """Decimal as text without trailing zeros: ``100.50`` -> ``100.5``, ``0.00`` -> ``0``."""
    plain = F.regexp_replace(col.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(col == 0, F.lit("0")).otherwise(plain)


def amount_text(col: Column) -> Column:
    """Size of the leading number of a text, without sign, leading or trailing zeros.

    Plain numbers are handled as text; very long ones and exponents go through a
    decimal. The prefix is repeated, not bound by ``let``: Spark computes it once in
    compiled code, where a function over an array would be interpreted for each row.
    """
    def plain(digits: Column) -> Column:
        short = F.when(digits.contains("."), F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))).otherwise(digits)
        # Leading zeros go, but one stays before a point or alone.
        return F.regexp_replace(F.ltrim(short, F.lit("0")), r"^(?=\.|\z)", "0")

    prefix = F.regexp_extract(col, UNSIGNED_PREFIX, 1)
    simple = (F.length(prefix) <= 15) & ~prefix.rlike("[eE]")
    return F.when(simple, plain(prefix)).otherwise(number_text(F.abs(lenient_amount(col))))


def transaction_key(date: Column, amount: Column, split: Column, created: Column) -> Column:
    """``date-|amount|-split-created`` with missing parts blank."""
    blank = [F.coalesce(c.cast("string"), F.lit("")) for c in (date, split, created)]
    return F.concat_ws("-", blank[0], amount_text(F.coalesce(amount, F.lit(""))), blank[1], blank[2])


def column_letter(index: Column) -> Column:
    """Zero-based column number to sheet letters (A..Z, AA..ZZ, AAA..ZZZ)."""
    def letter(n: Column) -> Column:
        return F.char((n % 26) + 65)

    two, three = index - 26, index - 26 - 26 * 26
    return (
        F.when(index < 26, letter(index))
        .when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )


def iso_timestamp(col: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds for a zoneless UTC timestamp."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def split_timestamp(utc: Column, zone: str = "America/Chicago") -> tuple[Column, Column]:
    """(date text, time text) of a zoneless UTC timestamp seen in ``zone``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm:ss")


def duration_hours(start: Column, end: Column) -> Column:
    """Hours between two timestamps as text with two decimals."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.format_string("%.2f", micros / F.lit(3_600_000_000.0))


def parse_dates(col: Column, formats: tuple[str, ...]) -> Column:
    """First format that fits; formats may be mixed within one column."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in formats])


def label(col: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Fixed value-to-label mapping as one CASE expression."""
    out = F
    for value, text in mapping.items():
        out = out.when(col == value, F.lit(text))
    return out.otherwise(F.lit(default))


def word_count_band(words: Column, target: Column) -> Column:
    """``short`` below 80 % of the target, ``long`` above 120 %, else ``on target``."""
    return (
        F.when(words < target * 0.8, "short")
        .when(words > target * 1.2, "long")
        .otherwise("on target")
    )


def score_band(score: Column) -> Column:
    """``low`` below 70, ``high`` from 90, else ``medium``."""
    return F.when(score < 70, "low").when(score >= 90, "high").otherwise("medium")
