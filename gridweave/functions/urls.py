"""URL expressions. All of them stay inside Catalyst; none needs Python workers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

# Fixed pattern: characters a URL sanitiser drops (everything outside the URL-safe ASCII set).
UNSAFE_CHARS = r"""[^a-zA-Z0-9$\-_.+!*'(),{}|\\^~\[\]`<>#%";/?:@&=]"""

# Fixed pattern: scheme, user, password, host, port, path, query, fragment.
URL_PARTS = (
    r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?"
    r"(?://(?:([^/?#:@]*)(?::([^/?#@]*))?@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?)?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)

# Fixed pattern: an http(s) URL with a well-formed host name.
VALID_HTTP_URL = (
    r"^https?://(?:[^/?#@]*@)?"
    r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*\.?"
    r"(?::\d+)?(?:[/?#].*)?$"
)

# What makes a link count as working.
VALID_STATUS_CODES = (200, 301, 302, 400, 403)
IMAGE_LINK = r"(?i)\.(jpg|jpeg|png|gif|webp)(\?.*)?$"
MAIL_LINK = r"(?i)mailto:"

# Sitemap priority by crawl batch, as (batch below, priority).
PRIORITY_STEPS = (
    (1, "1.0000"), (10, "0.9500"), (30, "0.8000"), (60, "0.7500"),
    (100, "0.6500"), (150, "0.4500"), (200, "0.1550"),
)
PRIORITY_FLOOR = "0.0850"


@dataclass(frozen=True)
class Parts:
    """URL components as columns; an absent component is the empty string."""

    scheme: Column
    user: Column
    password: Column
    host: Column
    port: Column
    path: Column
    query: Column
    fragment: Column

    def rebuild(self, host: Column | None = None, path: Column | None = None) -> Column:
        def wrap(before: str, col: Column, after: str = "") -> Column:
            return F.when(col != "", F.concat(F.lit(before), col, F.lit(after))).otherwise(F.lit(""))

        return F.concat(
            wrap("", self.scheme, "://"),
            self.user,
            wrap(":", self.password),
            F.when(self.user != "", F.lit("@")).otherwise(F.lit("")),
            self.host if host is None else host,
            wrap(":", self.port),
            self.path if path is None else path,
            wrap("?", self.query),
            wrap("#", self.fragment),
        )


def split_url(url: Column) -> Column:
    """All components as one array: the groups of a single match are joined, then split."""
    joined = F.regexp_replace(url, URL_PARTS, "\u0001".join(f"${i}" for i in range(1, 9)))
    return F.split(joined, "\u0001")


def parts(url: Column) -> Parts:
    pieces = split_url(url)
    return Parts(*[F.coalesce(F.get(pieces, F.lit(i)), F.lit("")) for i in range(8)])


def with_parts(url: Column, body: Callable[[Parts], Column]) -> Column:
    """``body`` over the components of ``url``, which is taken apart once."""
    return let(split_url(url), lambda a: body(Parts(*[F.coalesce(F.get(a, F.lit(i)), F.lit("")) for i in range(8)])))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 4)


def has_scheme(url: Column) -> Column:
    return url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")


def trim_right_slashes(col: Column) -> Column:
    return F.rtrim(col, F.lit("/"))


def with_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^(?!www\.)(?=.)", "www.")


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def remove_dot_segments(path: Column) -> Column:
    """Drop empty and ``.`` parts, let ``..`` remove the part before it, join by ``/``."""
    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(part.isin("", "."), kept)
            .otherwise(F.array_append(kept, part))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def normalize_url(url: Column) -> Column:
    """Sanitise, add ``www.``, fold dot segments unless it is a valid http(s) URL.

    The fold also removes the leading slash, and every scheme is rebuilt with
    ``://`` (``mailto:a@b`` becomes ``mailto://a@b``).
    """
    def rules(safe: Column) -> Column:
        valid = safe.rlike(VALID_HTTP_URL)
        return with_parts(
            safe, lambda p: p.rebuild(with_www(p.host), F.when(valid, p.path).otherwise(remove_dot_segments(p.path)))
        )

    return let(F.regexp_replace(url, UNSAFE_CHARS, ""), rules)


def normalize_sitemap_url(url: Column) -> Column:
    """``scheme://www.host/path`` with a lower-case host; query, fragment and port dropped."""
    return with_parts(url, lambda p: F.concat(p.scheme, F.lit("://www."), bare_host(F.lower(p.host)), p.path))


def ensure_www(url: Column) -> Column:
    def rules(u: Column) -> Column:
        return with_parts(u, lambda p: F.when(p.host == "", u).otherwise(p.rebuild(host=with_www(p.host))))

    return let(url, rules)


def parent_dir(path: Column) -> Column:
    """Path without its last part (``/a/b`` -> ``/a``, ``/a`` -> ``/``)."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base``, normalised for a sitemap."""
    def on_page(h: Column, b: Parts) -> Column:
        root = F.concat(b.scheme, F.lit("://www."), bare_host(b.host))
        folder = F.trim(parent_dir(trim_right_slashes(b.path)), F.lit("/"))
        middle = F.when(h.startswith("/"), F.lit("")).otherwise(F.concat(F.lit("/"), folder, F.lit("/")))
        return with_parts(
            F.concat(root, middle, h),
            lambda j: F.concat(j.scheme, F.lit("://"), j.host, F.lit("/"), remove_dot_segments(j.path)),
        )

    def rules(h: Column) -> Column:
        return F.when(has_scheme(h), h).otherwise(with_parts(base, lambda b: on_page(h, b)))

    return normalize_sitemap_url(trim_right_slashes(let(href, rules)))


def resolve_url_from_root(href: Column, base: Column) -> Column:
    """Every relative ``href`` counts from the host root; ``..`` parts are just removed."""
    def from_root(h: Column, root: Parts) -> Column:
        home = F.concat(root.scheme, F.lit("://"), root.host, F.lit("/"))
        path = F.ltrim(F.array_join(F.filter(F.split(h, "/"), lambda x: x != ".."), "/"), F.lit("/"))
        return let(path, lambda p: F.when(p == "", home).otherwise(trim_right_slashes(F.concat(home, p))))

    def rules(h: Column) -> Column:
        return F.when(has_scheme(h), trim_right_slashes(ensure_www(h))).otherwise(
            with_parts(ensure_www(base), lambda root: from_root(h, root))
        )

    return let(href, rules)


def is_internal(url: Column, site_url: Column) -> Column:
    """A link is internal when it starts with the site's own URL."""
    return url.startswith(site_url)


def domain_parts(url: Column) -> tuple[Column, Column, Column]:
    """(domain name, extension, base url) from the last two host labels."""
    labels = F.split(url_host(url), r"\.")
    name = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit(""))
    ext = F.element_at(labels, -1)
    return name, ext, F.concat(F.lit("https://www."), name, F.lit("."), ext)


def link_kind(href: Column, page_url: Column) -> Column:
    """``internal`` on an equal host, ``own`` when the site's word occurs, else ``external``."""
    def kind(host: Column) -> Column:
        word = F.coalesce(F.try_element_at(F.split(host, r"\."), F.lit(-2)), host)
        return F.when(url_host(href) == host, "internal").when(href.contains(word), "own").otherwise("external")

    return let(url_host(page_url), kind)


def is_valid_site_url(url: Column, site_name: Column | str) -> Column:
    """URL is well formed and its host contains the site's name."""
    name = site_name if isinstance(site_name, Column) else F.lit(site_name)
    return url.rlike(VALID_HTTP_URL) & url_host(url).contains(name)


def link_is_valid(url: Column, status: Column) -> Column:
    return status.isin(*VALID_STATUS_CODES) | url.rlike(IMAGE_LINK) | url.rlike(MAIL_LINK)


def sitemap_priority(depth: Column) -> Column:
    """1 minus the base-50 logarithm of depth + 1, kept in [0.1, 1], four decimals."""
    raw = F.lit(1.0) - F.ln(depth.cast("double") + 1) / F.ln(F.lit(50.0))
    return F.format_string("%.4f", F.least(F.greatest(raw, F.lit(0.1)), F.lit(1.0)))


def sitemap_priority_steps(batch: Column) -> Column:
    out = F
    for below, value in PRIORITY_STEPS:
        out = out.when(batch < below, F.lit(value))
    return out.otherwise(F.lit(PRIORITY_FLOOR))
