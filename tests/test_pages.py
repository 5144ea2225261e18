import pytest
from pyspark.sql import functions as F

from gridweave.functions import markup as M
from gridweave.operators import crawl, pages as P, score
from gridweave.operators.matching import first_keyword_match, type_lookup


def pages_of(spark, *htmls, site="https://www.ex.com"):
    return spark.createDataFrame([(i, site, site, h) for i, h in enumerate(htmls)], "page_id int, site string, url string, html string")


@pytest.mark.parametrize(
    "text, want",
    [("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&eacute;&#233;&#xE9;", "ééé"), ("&#128512;", "😀"), ("&nope; &", "&nope; &"), ("&#99999999;", "&#99999999;")],
)
def test_entities(value, text, want):
    assert value(M.decode_entities, text) == want


def test_attributes(value):
    read = lambda name: (lambda t: M.attribute(t, name))
    tag = """<a data-href="no" title='x href="y"' HREF = 'yes&amp;no' rel=nofollow>"""
    assert value(read("href"), tag) == "yes&no"
    assert value(read("rel"), tag) == "nofollow"
    assert value(read("name"), tag) == ""


def test_links(spark):
    html = (
        '<base href="https://b.org/"><a href="#x">1</a><a href="javascript:go()">2</a><a href=" /p q ">3</a><a>4</a>'
        '<!-- <a href="/hidden">5</a> --><script>"<a href=\'/s\'>"</script><a href="//cdn/x">6</a><a href="mailto:a@b">7</a>'
    )
    got = P.page_links(pages_of(spark, html), ["page_id"], "site").orderBy("position").collect()
    assert [r["url"] for r in got] == ["https://www.b.org/pq", "https://www.b.org/", "https://www.b.org/cdn/x", "mailto://a@b"]
    assert all(r["is_external"] for r in got)


def test_link_variants(spark):
    html = '<a href="/a">x</a><a href="/a/">y</a><a rel="nofollow" href="/b">z</a><a href="">e</a><a href="TEL:1">t</a><a href="../c">c</a>'
    df = pages_of(spark, html)
    assert {r["url"] for r in P.sitemap_links(df, ["page_id"], "url").collect()} == {"https://www.ex.com/a", "TEL://www.1", "https://www.ex.com/c"}
    got = [r["url"] for r in P.updater_links(df, ["page_id"], "url").orderBy("position").collect()]
    assert got == ["https://www.ex.com/a", "https://www.ex.com/a", "https://www.ex.com/b", "https://www.ex.com/c"]


def flags(spark, html):
    row = P.page_issues(pages_of(spark, html), ["page_id"]).first()
    return {n for n in P.ISSUES if row[n] == 1}


def test_issues(spark):
    good = (
        "<title>" + "t" * 40 + '</title><meta name="description" content="d"><link rel="canonical" href="/x"><h1>a</h1>'
    )
    assert flags(spark, good) == set()
    assert flags(spark, "") == {"Missing H1 Heading", "Missing Meta Description", "Missing Title Tag", "No Canonical Tag"}
    many = "<title>" + "é" * 31 + "</title><title>b</title><h1>a</h1><h1>b</h1>" + "<meta name='description' content='" + "m" * 161 + "'>" * 1
    assert flags(spark, many) == {
        "No Canonical Tag", "Title Tag Too Long", "Multiple Title Tags", "Multiple H1 Headings", "Meta Description Too Long",
    }
    two = good + '<meta name="description" content="again">'
    assert flags(spark, two) == {"Multiple Meta Descriptions"}
    blank = good.replace("t" * 40, "  ") + "<title>x</title>"
    assert flags(spark, blank) == {"Missing Title Tag"}
    assert flags(spark, good.replace('href="/x"', 'href=" "')) == {"No Canonical Tag"}
    assert flags(spark, good.replace("t" * 40, "<!-- --> " + "&amp;" * 29)) == {"Title Tag Too Short"}


def test_page_text(spark):
    html = '<meta charset="u"><meta name="description" content="D &amp; E"><p>one<b>!</b><p> two<div>x</div><style>p{}</style><p>three</p>'
    df = pages_of(spark, html)
    assert P.page_text(df, ["page_id"]).first()["text"] == "D & E one! two three"
    assert P.page_text(df, ["page_id"], max_elements=3).first()["text"] == "D & E one!"


def test_keywords_rank(spark):
    texts = spark.createDataFrame([("s", "b a b. A b"), ("s", "a"), ("t", "")], "site string, text string")
    got = P.top_keywords(texts, ["site"], top=4).orderBy("site", "row_no").collect()
    assert [(r["term"], r["occurrence"], r["word_count"], r["row_no"]) for r in got] == [
        ("a", 3, 1, 1), ("b", 3, 1, 2), ("b a b", 2, 3, 3), ("a b", 2, 2, 4),
    ]


def test_site_and_broken_links(spark):
    links = spark.createDataFrame(
        [("s", 1, 0, "u", True, False), ("s", 1, 1, "v", False, True), ("s", 1, 2, "u", False, True), ("s", 2, 0, "u", False, True), ("s", 2, 1, "w", True, False)],
        "site string, page_id int, position int, url string, is_internal boolean, is_external boolean",
    )
    site = P.site_links(links, ["site"], ["page_id", "position"])
    rows = {r["url"]: r for r in site.collect()}
    assert set(rows) == {"u", "v", "w"} and rows["u"]["is_internal"] and rows["u"]["status_code"] == 0
    status = spark.createDataFrame([("s", "u", 404), ("s", "v", 200)], "site string, url string, status int")
    checked = P.check_site_links(site, status, ["site"])
    got = {(r["page_id"], r["url"], r["status_code"]) for r in P.broken_links(links, checked, ["page_id"], ["site"]).collect()}
    assert got == {(1, "u", 404), (2, "u", 404), (2, "w", 0)}
    assert [r["url"] for r in P.unchecked_links(checked, ["site"], ["url"], 1).collect()] == ["w"]


def test_type_lookup(spark):
    types = spark.createDataFrame([(1, "404 Not Found"), (2, "Robots.txt Not Found"), (9, "Title Tag Too Long")], "type_id int, type_name string")
    items = spark.createDataFrame([("not found",), ("404",), ("title tag",), ("zzz",), ("",), (None,), ("",)], "issue string")
    want = {"not found": 2, "404": 1, "title tag": 9, "zzz": 21, "": 9, None: 21}
    got = type_lookup(items, "issue", types).collect()
    assert {r["issue"]: r["type_id"] for r in got} == want and len(got) == 7


def test_first_keyword_match_with_equal_positions(spark):
    events = spark.createDataFrame([(1, "Call with ACME and Bolt"), (1, "nothing"), (2, None)], "id int, title string")
    clients = spark.createDataFrame([("b", "bolt", 1), ("a", "acme", 1), ("z", "", 0)], "client string, keyword string, position int")
    got = first_keyword_match(events, "id", F.col("title"), clients, "client").collect()
    assert sorted((r["id"], r["title"] or "", r["client"]) for r in got) == [(1, "Call with ACME and Bolt", "a"), (1, "nothing", ""), (2, "", "")]


def test_crawl_depth_raises_when_not_settled(spark):
    edges = spark.createDataFrame([("s", str(i), str(i + 1)) for i in range(5)], "site string, src string, dst string")
    with pytest.raises(RuntimeError):
        crawl.crawl_depth(edges, spark.createDataFrame([("s", "0")], "site string, url string"), max_rounds=2)


def test_crawl_depth(spark):
    edges = [("s", "r", "a"), ("s", "r", "b"), ("s", "a", "c"), ("s", "c", "r"), ("s", "b", "c"), ("s", "x", "y"), ("t", "r", "q")]
    got = crawl.crawl_depth(
        spark.createDataFrame(edges, "site string, src string, dst string"),
        spark.createDataFrame([("s", "r"), ("t", "r")], "site string, url string"), None,
    )
    want = {("s", "r", 0), ("s", "a", 1), ("s", "b", 1), ("s", "c", 2), ("t", "r", 0), ("t", "q", 1)}
    assert {tuple(r) for r in got.collect()} == want
    capped = crawl.crawl_depth(
        spark.createDataFrame(edges, "site string, src string, dst string"), spark.createDataFrame([("s", "r")], "site string, url string"), 2
    )
    assert {(r["url"], r["depth"]) for r in capped.collect()} == {("r", 0), ("a", 1)}


def stats(spark, rows):
    return spark.createDataFrame(rows, "website string, crawl_id int, pages_crawled int, issues bigint, warnings bigint, notices bigint, information bigint")


def test_site_score(spark):
    pop = stats(spark, [("a", 1, 10, 0, 0, 0, 0), ("b", 2, 10, 10, 5, 0, 0), ("c", 3, 10, 5, 0, 0, 0)])
    got = {r["website"]: r["site_score"] for r in score.site_scores(pop, pop).collect()}
    assert got == {"a": 100.0, "b": 0.0, "c": 58.33}
    other = stats(spark, [("d", 9, 10, 100, 100, 0, 0), ("e", 8, 0, 1, 0, 0, 0)])
    out = {r["website"]: r["site_score"] for r in score.site_scores(pop, other).collect()}
    assert out == {"d": 0.0, "e": None}
    flat = stats(spark, [("a", 1, 10, 1, 0, 0, 0), ("b", 2, 10, 1, 0, 0, 0)])
    assert {r["site_score"] for r in score.site_scores(flat, flat).collect()} == {None}


def test_latest_crawls(spark):
    rows = [
        ("a", 1, 6, 3, True, False, "2024-07-01"), ("a", 2, 6, 3, True, False, "2024-07-02"), ("a", 3, 5, 3, True, False, "2024-07-02"),
        ("a", 4, 6, 2, True, False, "2024-07-02"), ("a", 5, 6, 3, False, False, "2024-07-02"), ("a", 6, 6, 3, True, True, "2024-07-02"),
        ("b", 7, 6, 3, True, False, "2024-06-05"),
    ]
    df = spark.createDataFrame(rows, "website string, crawl_id int, pages_crawled int, issues_found int, complete boolean, is_test boolean, d string")
    got = score.latest_crawls(df.withColumn("crawled_at", F.col("d").cast("timestamp_ntz"))).collect()
    assert [tuple(r) for r in got] == [("a", 2)]


def test_link_counts_of_pages_without_links(spark):
    pages = spark.createDataFrame([(1, "<a href='http://www.a.de/x'>1</a><a href='http://b.de/'>2</a>", "http://www.a.de"), (2, "none", "http://www.a.de"), (3, None, "http://www.a.de")], "page_id int, html string, site_url string")
    links = P.page_links(pages, ["page_id"], "site_url")
    got = P.link_counts(links, ["page_id"], pages)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_crawl_depth_by_routes(spark):
    """Cycles, a link to itself, two routes of unequal length, repeated links, an unreached url, nulls, two sites."""
    from gridweave.operators.crawl import crawl_depth, crawl_depth_by_routes

    pairs = ["ab", "bc", "ca", "cc", "ad", "de", "ec", "ef", "ab", "xy"]
    rows = [("s", *p) for p in pairs] + [("t", "a", "f"), ("t", None, "g"), ("t", "f", None), (None, "a", "h")]
    edges = spark.createDataFrame(rows, "site string, src string, dst string")
    roots = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "a")], "site string, url string")
    found = {tuple(r) for r in crawl_depth(edges, roots).collect()}
    assert found == {tuple(r) for r in crawl_depth_by_routes(edges, roots, 6).collect()}
    assert {("s", "c", 2), ("s", "f", 3), ("t", "f", 1), ("t", None, 2)} <= found and len(found) == 9
    assert crawl_depth(edges, roots.limit(0)).count() == 0
    assert crawl_depth(edges.limit(0), roots).count() == 2
