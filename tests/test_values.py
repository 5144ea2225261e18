from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridweave.functions import text as X
from gridweave.functions import values as V


@pytest.mark.parametrize(
    "amount, want",
    [("-100.50", "100.5"), ("", "0"), (None, "0"), ("0.00", "0"), ("007.10 USD", "7.1"), ("abc", "0"), (".5", "0.5"), ("1e3", "1000"),
     ("12.", "12"), ("  42", "42"), ("1234567890123456.50", "1234567890123456.5"), ("100", "100")],
)
def test_amount_in_transaction_key(value, amount, want):
    got = value(lambda d, a: V.transaction_key(d, a, F.lit(None).cast("string"), F.lit("x")), "2025-02-11", amount)
    assert got == f"2025-02-11-{want}--x"


def test_transaction_key_samples(value):
    key = lambda d, a, s, c: V.transaction_key(d, a, s, c)
    assert value(key, "2025-02-11", "-100.50", "", "2025-01-01") == "2025-02-11-100.5--2025-01-01"
    assert value(key, "2025-03-01", None, None, None) == "2025-03-01-0--"


@pytest.mark.parametrize("i, want", [(0, "A"), (25, "Z"), (26, "AA"), (51, "AZ"), (52, "BA"), (701, "ZZ"), (702, "AAA"), (18277, "ZZZ")])
def test_column_letter(value, i, want):
    assert value(V.column_letter, i, types=["int"]) == want


@pytest.mark.parametrize("given, want", [(None, "d"), ("", "d"), ("0", "d"), ("a", "a"), ("0.0", "d"), ("10", "10")])
def test_or_default(value, given, want):
    assert value(lambda c: V.or_default(c, "d"), given) == want


def test_dates_and_durations(value):
    t = datetime(2024, 1, 20, 3, 4, 5, 678000)
    assert value(V.iso_timestamp, t, types=["timestamp_ntz"]) == "2024-01-20T03:04:05.678Z"
    day, clock = V.split_timestamp(F.col("a0"))
    assert value(lambda c: F.concat_ws(" ", day, clock), t, types=["timestamp_ntz"]) == "2024-01-19 21:04:05"
    summer = datetime(2024, 7, 1, 0, 0, 0)
    assert value(lambda c: F.concat_ws(" ", day, clock), summer, types=["timestamp_ntz"]) == "2024-06-30 19:00:00"
    assert value(V.duration_hours, datetime(2024, 1, 1), datetime(2024, 1, 1, 1, 30), types=["timestamp_ntz"] * 2) == "1.50"


def test_mixed_date_formats(value):
    from gridweave.sources.readers import SHEET_DATE_FORMATS

    parse = lambda c: V.parse_dates(c, SHEET_DATE_FORMATS)
    assert value(parse, "2023-10-02 8:00:00") == datetime(2023, 10, 2, 8)
    assert value(parse, "1/21/2025 17:35:55") == datetime(2025, 1, 21, 17, 35, 55)
    assert value(parse, "soon") is None


def test_fallbacks_and_ids(value):
    assert value(V.first_text, "", "b") == "b"
    assert value(V.first_text, None, "b") == "b"
    assert value(V.resource_id, "spaces/XY") == "XY"


def test_bands(value):
    assert [value(V.score_band, s, types=["int"]) for s in (69, 70, 89, 90)] == ["low", "medium", "medium", "high"]
    band = lambda w: V.word_count_band(w, F.lit(100))
    assert [value(band, w, types=["int"]) for w in (79, 80, 120, 121)] == ["short", "on target", "on target", "long"]
    assert value(lambda c: V.label(c, V.LOG_COLOURS), "Error") == "#f4cccc"


def test_words_and_quality(value):
    assert value(X.word_count, "  a b\n\tc ") == 3
    assert value(X.word_count, "") == 0
    quality = lambda t, n: X.text_quality(t, F.lit(100), n)
    score = lambda t, n: value(quality, t, n, types=["string", "int"])
    assert score("plain", 100) == 90
    assert score("plain", 85) == 85
    assert score("plain", 75) == 80
    assert score("plain", 60) == 70
    assert score('he "saw" and heard, felt, smelt taste of scent', 100) == 100
    assert score("a\nb\nc\nd\ne", 75) == 85
    assert score("x" * 1001, 75) == 75


def test_emails(value):
    assert value(X.extract_email, "none", "write to a.b@c.example now") == "a.b@c.example"
    assert value(X.extract_email, "x@y.zz", "a@b.cc") == "x@y.zz"
    assert value(X.extract_email, "", None) == ""
    assert [value(X.valid_email, e) for e in ("a@b.c", "a b@c.d", "a@b", None)] == [True, False, False, False]


def test_keywords(value):
    keep = lambda c: X.keyword_filter(c, ["Go", "run"], ["walk"])
    assert [value(keep, t) for t in ("they GO", "walk and go", "stay")] == [True, False, False]
    assert value(lambda a, b: X.search_all([a, b], "O B"), "foo", "bar") is True


@pytest.mark.parametrize(
    "bad, want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('Sure {"a": 1, // note\n "b": [1,2,],}', '{"a": 1, \n "b": [1,2]}'),
        ("{a: 1, b_2 : 2}", '{"a": 1, "b_2" : 2}'),
        ('{"a" "x"}', '{"a" :"x"}'),
        ('{"a": /* c */ 1}', '{"a":  1}'),
        ("no object", "no object"),
    ],
)
def test_repair_json(value, bad, want):
    assert value(X.repair_json, bad) == want


def test_extract_json_object(value):
    assert value(X.extract_json_object, 'x {"a":{}}\n} y') == '{"a":{}}\n}'
    assert value(X.extract_json_object, "none") == ""


@pytest.mark.parametrize(
    "kind, raw, want",
    [
        ("number", '{"value": 5.0}', "5"), ("number", '{"value": 1.25}', "1.25"), ("percentage", '{"value": 0.15}', "0.15"),
        ("currency", '{"value": 12.5, "currency": "EUR"}', "EUR 12.5"), ("date", '{"value": "2024-01-01"}', "2024-01-01"),
        ("list", '{"value": ["a", "b"]}', "a, b"), ("options:a, b", '{"value": "b"}', "b"), ("multioptions:a,b", '{"value": "a"}', "a"),
        ("multioptions:a,b", '{"value": ["a","b"]}', "a, b"), ("list", "oops", "oops"), ("text", '{"value": 1}', '{"value": 1}'),
        ("unknown", '{"value": 1}', '{"value": 1}'),
    ],
)
def test_parse_typed(value, kind, raw, want):
    assert value(lambda c: X.parse_typed(c, kind), raw) == want


def test_output_schema_and_hints():
    assert X.output_schema("text") is None and X.output_schema("json") is None
    assert X.output_schema("currency")["required"] == ["value", "currency"]
    assert X.output_schema("options:a, b")["properties"]["value"]["enum"] == ["a", "b"]
    assert X.format_hint("options:a, b") == "Return exactly one of these values: a, b."
    assert X.format_hint("colour") == X.OTHER_HINT


def test_clean_text(value):
    assert value(X.clean_text, "Ab-c 1é!") == "Abc 1"
    assert value(lambda c: X.clean_text(c, False), "a b") == "ab"
    assert value(lambda c: F.length(X.clean_text(c, True, 2500)), "x" * 3000) == 2500
    assert value(lambda c: F.length(X.clean_text(c, True, None)), "x" * 3000) == 3000


def test_quality_without_a_target(value):
    from gridweave.functions import text as T
    from pyspark.sql import functions as F

    assert value(lambda t: T.text_quality(t, F.lit(0), F.lit(50)), "plain") == value(lambda t: T.text_quality(t, F.lit(10), F.lit(50)), "plain")
