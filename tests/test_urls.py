import pytest
from pyspark.sql import functions as F

from gridweave.functions import urls as U


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://x.com/für", "https://www.x.com/fr"),
        ("https://www.x.com/a/../b", "https://www.x.com/a/../b"),
        ("mailto:a@b", "mailto://a@b"),
        ("x.com/a/../b/./c", "x.com/b/c"),
        ("/a/../b", "b"),
        ("http://u:p@x.com:8080/p?q=1#f", "http://u:p@www.x.com:8080/p?q=1#f"),
        ("HTTP://x.com", "HTTP://www.x.com"),
        ("ftp://x.com/a//b", "ftp://www.x.coma/b"),
        ("https://bad_host.com/a/./b", "https://www.bad_host.coma/b"),
    ],
)
def test_normalize_url(value, url, want):
    assert value(U.normalize_url, url) == want


@pytest.mark.parametrize("url", ["https://x.com/a?b=1", "http://www.y.org/z/../q#t"])
def test_normalize_is_stable_on_http(value, url):
    once = value(U.normalize_url, url)
    assert value(U.normalize_url, once) == once


def test_sitemap_form_and_www(value):
    assert value(U.normalize_sitemap_url, "https://WWW.Ex.com:80/P?q#f") == "https://www.ex.com/P"
    assert value(U.ensure_www, "https://ex.com/p?q=1#f") == "https://www.ex.com/p?q=1#f"
    assert value(U.ensure_www, "just text") == "just text"


@pytest.mark.parametrize("path, want", [("/a/./b/../c", "a/c"), ("../../x", "x"), ("", ""), ("a//b/", "a/b"), ("/..", "")])
def test_dot_segments(value, path, want):
    assert value(U.remove_dot_segments, path) == want


@pytest.mark.parametrize(
    "href, base, want",
    [
        ("/x/../y", "https://ex.com/a/b", "https://www.ex.com/y"),
        ("z", "https://ex.com/a/b/c", "https://www.ex.com/a/b/z"),
        ("z/", "https://www.ex.com", "https://www.ex.com/z"),
        ("https://Other.org/p/?q", "https://ex.com", "https://www.other.org/p/"),
        ("../up", "https://ex.com/a/b/c", "https://www.ex.com/a/up"),
    ],
)
def test_resolve_url(value, href, base, want):
    assert value(U.resolve_url, href, base) == want


@pytest.mark.parametrize(
    "href, want",
    [("a/../b", "https://www.ex.com/a/b"), ("/", "https://www.ex.com/"), ("/p/", "https://www.ex.com/p"), ("http://o.net/", "http://www.o.net")],
)
def test_resolve_from_root(value, href, want):
    assert value(lambda h: U.resolve_url_from_root(h, F.lit("https://ex.com/deep/page")), href) == want


def test_kinds_and_parts(value):
    kind = lambda h: U.link_kind(h, F.lit("https://shop.ex.com/a"))
    assert value(kind, "https://shop.ex.com/b") == "internal"
    assert value(kind, "https://other.org/ex-libris") == "own"
    assert value(kind, "https://other.org/b") == "external"
    name, ext, base = U.domain_parts(F.col("a0"))
    assert value(lambda u: F.concat_ws("|", name, ext, base), "https://a.b.co/x") == "b|co|https://www.b.co"


def test_validity(value):
    ok = lambda u, s: U.link_is_valid(u, s)
    check = lambda u, s: value(ok, u, s, types=["string", "int"])
    assert [check("http://x/y", s) for s in (200, 301, 302, 400, 403, 404, 500)] == [True] * 5 + [False] * 2
    assert check("http://x/y.PNG?v=1", 404) and check("MAILTO:a@b", 0) and not check("http://x/png", 404)
    site = lambda u: U.is_valid_site_url(u, "ex.com")
    assert value(site, "https://www.ex.com/a") and not value(site, "https://other.com/ex.com") and not value(site, "www.ex.com")


@pytest.mark.parametrize("depth, want", [(0, "1.0000"), (1, "0.8228"), (6, "0.5026"), (49, "0.1000"), (400, "0.1000")])
def test_priority(value, depth, want):
    assert value(U.sitemap_priority, depth, types=["int"]) == want


def test_priority_steps(value):
    got = [value(U.sitemap_priority_steps, b, types=["int"]) for b in (0, 9, 10, 59, 60, 149, 199, 200)]
    assert got == ["1.0000", "0.9500", "0.8000", "0.7500", "0.6500", "0.4500", "0.1550", "0.0850"]
