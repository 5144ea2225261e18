"""The HTML tokenizer and what the audit reads from its elements."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridweave.functions.tokens import elements, tokens  # noqa: E402
from gridweave.operators import pages as P  # noqa: E402

CASES = [
    ("", []),
    ("a < b <3 &lt; c", [("text", "", "a <"), ("text", "", " b <"), ("text", "", "3 < c")]),
    ('<a href="x>y" REL=\'q">\' b>t</a >', [("start", "a", {"href": "x>y", "rel": 'q">', "b": ""}), ("text", "", "t"), ("end", "a", {})]),
    ("<a href=x/y/ b=1 href=z>", [("start", "a", {"href": "x/y/", "b": "1"})]),
    ("<br/><a/b>", [("start", "br", {}), ("start", "a", {"b": ""})]),
    ("1<!-- <h1> -- > -->2<!-->3<!--->4<!--x--!>5<!-- open <h1>", [("text", "", c) for c in "12345"]),
    ("<!DOCTYPE html><?php a ?><![CDATA[ <h1>x</h1> ]]>y", [("text", "", "x"), ("end", "h1", {}), ("text", "", " ]]>y")]),
    ("</>1</ b>2", [("text", "", "1"), ("text", "", "2")]),
    ("<script>if (a<b) '<h1>' </scripts></SCRIPT >x", [("start", "script", {}), ("end", "script", {}), ("text", "", "x")]),
    ("<style>a > b", [("start", "style", {})]),
    ("<title>1 &amp; <b>2</title>x", [("start", "title", {}), ("text", "title", "1 & <b>2"), ("end", "title", {}), ("text", "", "x")]),
    ("<a title='&eacute;&notit;&copy=1&copy &#x41;&#66' x=&amp;lt;>", [("start", "a", {"title": "é&notit;&copy=1© AB", "x": "&lt;"})]),
    ("&NotEqualTilde; &copyright &#128; &unknown;", [("text", "", "≂̸ ©right € &unknown;")]),
    ('x<a href="open>y</a>', [("text", "", "x")]),
    ("x<a href", [("text", "", "x")]),
    ("<h1\n>", [("start", "h1", {})]),
    ('<p =a="1">', [("start", "p", {"=a": "1"})]),
]


@pytest.mark.parametrize("html, want", CASES)
def test_tokens(html, want):
    assert list(tokens(html)) == want


def test_tokens_of_any_text_end():
    """No markup makes the tokenizer loop, fail or read a place twice."""
    import random

    rng = random.Random(3)
    parts = ["<", ">", "</", "<!--", "-->", "<!", "'", '"', "=", "a", "p", "title", "script", "/", " ", "&", "&amp;", "]]>", "\n", "h1", "é"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert sum(len(t[2]) if t[0] == "text" else len(t[1]) for t in tokens(html)) <= 2 * len(html)
        elements(html, P.ELEMENTS)


def test_elements():
    html = "<title> A </title><p>one <b>two</b><p>three<div>no</div><h1>x</h1><meta name=description content='a>b'><p>open"
    assert elements(html, P.ELEMENTS) == [
        ("title", {}, "A"), ("p", {}, "one two"), ("p", {}, "three"), ("h1", {}, ""),
        ("meta", {"name": "description", "content": "a>b"}, ""), ("p", {}, "open"),
    ]


def test_elements_read_closed_references_only(spark):
    """A title cut within its last reference keeps it as written (found on larger pages), as the expressions and the SQL have it."""
    rows = [(1, f"<title>{'a' * 56} &amp</title>"), (2, f"<title>{'a' * 28}&amp;&amp</title><p>&lt &#65 &copyright; &eacute;"), (3, "<a href='?a=1&copy' rel='&amp;&amp'>")]
    assert [elements(h, P.ELEMENTS)[-1] for _, h in rows] == [("title", {}, "a" * 56 + " &amp"), ("p", {}, "&lt &#65 &copyright; é"), ("a", {"href": "?a=1&copy", "rel": "&&amp"}, "")]
    pages = spark.createDataFrame(rows, "id int, html string")
    parsed = P.page_elements(pages, ["id"])
    flags = {r["id"]: r for r in P.element_issues(parsed, ["id"]).collect()}
    assert flags[1]["Title Tag Too Long"] == 1 and flags[2]["Title Tag Too Short"] == 0
    assert flags == {r["id"]: r for r in P.page_issues(pages, ["id"]).collect()}


FLAGS = {
    "Missing H1 Heading": ("<h2>a</h2><!-- <h1>b</h1>", "<h1>b</h1>"),
    "Missing Meta Description": ("<!-- <meta name=description>", "<meta content='a > b' name='description'>"),
    "Missing Title Tag": ("<title> &#32; </title><title>second</title>", "<title>a<b</title>"),
    "No Canonical Tag": ("<link rel=canonical href=' '>", "<link data-x='>' rel=canonical href=/a>"),
    "Meta Description Too Long": (f"<meta name=description content='{'é' * 81}'>", f"<meta name=description content='{'é' * 80}'>"),
    "Title Tag Too Long": (f"<title>{'&eacute;' * 31}</title>", f"<title>{'&eacute;' * 30}</title>"),
    "Title Tag Too Short": ("<title>short &amp; &LongLeftArrow;</title>", f"<title>{'a' * 30}</title>"),
    "Multiple Title Tags": ("<title>a</title><title x='</title>'>b</title>", "<title>a <title>b</title>"),
    "Multiple Meta Descriptions": ("<meta name=description><meta name=description>", "<meta name=description><meta name=Description>"),
    "Multiple H1 Headings": ("<h1>a<h1 b='>'>", "<h1>a</h1><script><h1></script>"),
}


def test_flags_both_ways(spark):
    """Each of the ten flags raised and not raised by odd markup, with its links and texts from the same pass."""
    rows = [(n, k, html) for n, pair in FLAGS.items() for k, html in enumerate(pair)]
    df = spark.createDataFrame([*rows, ("null", 0, None), ("empty", 0, "")], "name string, kind int, html string")
    parsed = P.page_elements(df, ["name", "kind"])
    got = {(r["name"], r["kind"]): r for r in P.element_issues(parsed, ["name", "kind"]).collect()}
    for name in FLAGS:
        assert (got[name, 0][name], got[name, 1][name]) == (1, 0), name
    assert set(P.ISSUES) == set(FLAGS) and got["null", 0][2:] == got["empty", 0][2:] == (1, 1, 1, 1, 0, 0, 0, 0, 0, 0)
    odd = spark.createDataFrame([(1, "<base href='/b>'><a href=\"x>y\" rel=nofollow>1</a><meta name=description content=d><p>t<!-- a --> u<a>2</a>"), (2, None)], "id int, html string")
    parsed = P.page_elements(odd, ["id"])
    assert [tuple(r) for r in P.element_links(parsed, ["id"]).orderBy("position").collect()] == [(1, "/b>", 0, "x>y", "nofollow"), (1, "/b>", 1, "", "")]
    assert {tuple(r) for r in P.element_text(parsed, ["id"]).collect()} == {(1, 2, "d t u2"), (2, 0, "")}


def test_plain_markup_reads_the_same_both_ways(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    parsed = P.page_elements(pages, ["page_id"])
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(P.element_issues(parsed, ["page_id"])) == rows(P.page_issues(pages, ["page_id"]))
    assert rows(P.element_links(parsed, ["page_id"])) == rows(P.raw_links(pages, ["page_id"]))
    assert rows(P.element_text(parsed, ["page_id"])) == rows(P.page_text(pages, ["page_id"]))
