"""Text, keyword, e-mail and JSON-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and word lists.
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
WHOLE_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
SENSE_WORDS = (
    "saw|see|look|vision|sight|appear",
    "heard|hear|sound|noise|listen",
    "feel|felt|touch|texture|smooth|rough",
    "smell|scent|aroma|odor",
    "taste|flavor|sweet|sour|bitter",
)

# Format hint per output type.
FORMAT_HINTS = {
    "number": "Return the numerical value only.",
    "currency": "Return number and ISO currency code.",
    "percentage": "Return the percentage as a decimal (e.g., 0.15).",
    "date": "Return the date in YYYY-MM-DD.",
    "list": "Return a bullet list of items.",
    "json": "Return a well-formed JSON object.",
}
TEXT_HINT = "Provide a clear, comprehensive text answer."
OTHER_HINT = "Provide the answer in the requested format."
SCHEMA_LINE = "Respond with JSON that matches the required schema exactly."


def word_count(col: Column) -> Column:
    return F.size(F.filter(F.split(col, r"\s+"), lambda w: w != ""))


def text_quality(text: Column, target: Column, actual: Column) -> Column:
    """0-100: base 80, plus or minus length fit, dialogue, paragraphs and sense words."""
    # Anything over a target of 0 is far too long; nothing over it has no ratio.
    beyond = F.when((target == 0) & (actual > 0), F.lit(float("inf")))
    ratio = F.coalesce(beyond, F.try_divide(actual.cast("double"), target.cast("double")))
    fit = (
        F.when(ratio.between(0.9, 1.1), 10)
        .when(ratio.between(0.8, 1.2), 5)
        .when((ratio < 0.7) | (ratio > 1.3), -10)
        .otherwise(0)
    )
    lines = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"\S"))
    senses = sum((text.rlike(f"(?i){words}").cast("int") for words in SENSE_WORDS), F.lit(0))
    score = (
        F.lit(80)
        + fit
        + F.when(text.contains('"'), 5).otherwise(0)
        + F.when(F.size(lines) >= 5, 5).otherwise(0)
        - F.when(F.exists(lines, lambda p: F.length(p) > 1000), 5).otherwise(0)
        + F.least(senses * 2, F.lit(10))
    )
    return F.greatest(F.least(score, F.lit(100)), F.lit(0))


def contains_any(col: Column, words: list[str]) -> Column:
    """Text holds at least one of the words, ignoring case."""
    low = F.lower(col)
    out = F.lit(False)
    for word in words:
        out = out | low.contains(word.lower())
    return out


def keyword_filter(short: Column, any_of: list[str], none_of: list[str]) -> Column:
    return contains_any(short, any_of) & ~contains_any(short, none_of)


def extract_email(*texts: Column) -> Column:
    """First e-mail address of the first text that has one, else blank."""
    found = [F.nullif(F.regexp_extract(t, EMAIL_IN_TEXT, 0), F.lit("")) for t in texts]
    return F.coalesce(*found, F.lit(""))


def valid_email(col: Column) -> Column:
    return F.coalesce(col.rlike(WHOLE_EMAIL), F.lit(False))


def clean_text(col: Column, keep_spaces: bool = True, max_chars: int | None = None) -> Column:
    """ASCII letters and digits (and spaces) only, cut to ``max_chars`` when given."""
    kept = F.regexp_replace(col, r"[^A-Za-z0-9 ]" if keep_spaces else r"[^A-Za-z0-9]", "")
    return kept if max_chars is None else F.substring(kept, 1, max_chars)


def search_all(cols: list[Column], term: str) -> Column:
    """Any shown column contains the term, ignoring case."""
    shown = F.concat_ws(" ", *[c.cast("string") for c in cols])
    return F.contains(F.lower(shown), F.lit(term.lower()))


def strip_to_braces(col: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` (either end open when missing)."""
    return F.regexp_replace(F.regexp_replace(col, r"(?s)^[^{]+(?=\{)", ""), r"(?s)\}[^}]*\z", "}")


def repair_json(col: Column) -> Column:
    """Drop code fences, text around the object, comments and trailing commas;
    then quote bare keys and add missing colons."""
    text = F.regexp_replace(col, r"```json|```", "")
    text = strip_to_braces(text)
    text = F.regexp_replace(text, r"//[^\n\r]*", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r",(\s*[\]}])", "$1")
    text = F.regexp_replace(text, r"""("[^"]+")(\s+)(?=[{\["'])""", "$1$2:")
    return F.regexp_replace(text, r"([{,]\s*)([a-zA-Z0-9_]+)(\s*:)", '$1"$2"$3')


def extract_json_object(col: Column) -> Column:
    """Widest ``{...}`` stretch of a text; blank when there is none."""
    return F.regexp_extract(col, r"(?s)\{.*\}", 0)


def parse_typed(raw: Column, output_type: str) -> Column:
    """Value of a structured answer as text; the raw text when it does not parse."""
    kind = output_type.split(":")[0]
    if kind in ("", "text"):
        return raw
    whole = F.try_parse_json(raw)
    value = F.try_variant_get(whole, "$.value", "string")
    number = F.try_variant_get(whole, "$.value", "double")
    as_number = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )
    items = F.array_join(F.try_variant_get(whole, "$.value", "array<string>"), ", ")
    answers = {
        "number": as_number,
        "percentage": as_number,
        "currency": F.concat(F.try_variant_get(whole, "$.currency", "string"), F.lit(" "), as_number),
        "date": value,
        "list": items,
        "options": value,
        "multioptions": F.coalesce(items, value),
        "json": F.to_json(whole),
    }
    return F.coalesce(answers.get(kind, raw), raw)


def format_hint(output_type: str) -> str:
    kind, _, options = output_type.partition(":")
    if kind in ("", "text"):
        return TEXT_HINT
    if kind == "options":
        return f"Return exactly one of these values: {options}."
    if kind == "multioptions":
        return f"Return a comma-separated list of **all** matching values from: {options}."
    return FORMAT_HINTS.get(kind, OTHER_HINT)


def output_schema(output_type: str) -> dict | None:
    """JSON schema of a structured answer; None for free text and free JSON."""
    kind, _, rest = output_type.partition(":")
    options = [o.strip() for o in rest.split(",")]
    values = {
        "number": {"type": "number"},
        "percentage": {"type": "number"},
        "currency": {"type": "number"},
        "date": {"type": "string", "format": "date"},
        "list": {"type": "array", "items": {"type": "string"}},
        "options": {"type": "string", "enum": options},
        "multioptions": {"type": "array", "minItems": 0, "items": {"type": "string", "enum": options}},
    }
    if kind not in values:
        return None
    properties = {"value": values[kind]}
    if kind == "currency":
        properties["currency"] = {"type": "string"}
    return {
        "type": "object",
        "additionalProperties": False,
        "required": list(properties),
        "properties": properties,
    }


def build_prompt(instruction: str, row_text: Column, output_type: str) -> Column:
    """Instruction, row text and format hint as one prompt column."""
    tail = format_hint(output_type)
    if output_schema(output_type) is not None:
        tail += "\n\n" + SCHEMA_LINE
    head = f"{instruction}\n\nHere are the column-value pairs for the record:\n"
    return F.trim(F.concat(F.lit(head), row_text, F.lit("\n\n" + tail)))


def row_to_text(cols: list[str]) -> Column:
    """``header: value`` lines in column order."""
    lines = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in cols
    ]
    return F.concat_ws("\n", *lines)
