"""Site audit over stored pages: links, issues, items, texts, keywords."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import markup as M
from ..functions import urls as U
from ..functions.text import clean_text
from ..functions.tokens import elements
from ..functions.values import unfold
from ..session import by_bytes, cut_lineage
from .matching import type_lookup
from .ordering import first_k_per_group
from .reshape import flags_to_items

# The issue names, in report order.
ISSUES = [
    "Missing H1 Heading",
    "Missing Meta Description",
    "Missing Title Tag",
    "No Canonical Tag",
    "Meta Description Too Long",
    "Title Tag Too Long",
    "Title Tag Too Short",
    "Multiple Title Tags",
    "Multiple Meta Descriptions",
    "Multiple H1 Headings",
]
# Length limits in bytes.
MAX_DESCRIPTION, MAX_TITLE, MIN_TITLE = 160, 60, 30

SITEMAP_NOT_INDICATED = "Sitemap Not Indicated in Robots.txt"
ROBOTS_NOT_FOUND = "Robots.txt Not Found"
SITEMAP_NOT_FOUND = "Sitemap Not Found"
BROKEN_LINK = "Broken Link"


#: A row number that no group reaches.
ALL_ROWS = (1 << 31) - 1


#: Elements that the audit reads.
ELEMENTS = frozenset(["a", "base", "h1", "link", "meta", "p", "title"])


def page_elements(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(keep, elements) of each page: an array of (tag, attrs, text) in page order, read in one pass.

    The tokenizer reads markup as browsers do, which expressions can't: quoted `>`, unclosed
    comments, declarations, raw texts, all character references that end with a semicolon. A null page has no elements.
    From here :func:`element_issues`, :func:`element_text` and :func:`element_links` need no
    markup any more.
    """
    kind = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [elements(h or "", ELEMENTS) for h in part.column("_html").to_pylist()]
                rows = pa.array([[{"tag": t, "attrs": list(a.items()), "text": x} for t, a, x in e] for e in found], kind)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], rows], names=[*keep, "elements"])

    slim = pages.select(*keep, F.col(html).alias("_html"))
    schema = StructType(slim.drop("_html").schema.fields + StructType.fromDDL("elements array<struct<tag:string,attrs:map<string,string>,text:string>>").fields)
    return slim.mapInArrow(read, schema)


def _attr(element: Column, name: str) -> Column:
    return F.coalesce(F.element_at(element["attrs"], name), F.lit(""))


def element_issues(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The ten flags of :func:`page_issues` from the elements of :func:`page_elements`."""
    of = lambda tag: F.filter("elements", lambda e: e["tag"] == tag)
    facts = parsed.select(
        *keep,
        F.coalesce(F.get(of("title"), F.lit(0))["text"], F.lit("")).alias("_title"),
        F.size(of("h1")).alias("_h1"),
        F.size(of("title")).alias("_titles"),
        F.filter(of("meta"), lambda e: _attr(e, "name") == "description").alias("_described"),
        F.size(F.filter(of("link"), lambda e: (_attr(e, "rel") == "canonical") & (M.strip_space(_attr(e, "href")) != ""))).alias("_canonical"),
    )
    counted = facts.select(
        *keep, "_title", "_h1", "_titles", "_canonical", F.size("_described").alias("_metas"), F.octet_length("_title").alias("_bytes"),
        F.octet_length(F.coalesce(_attr(F.get("_described", F.lit(0)), "content"), F.lit(""))).alias("_meta_bytes"),
    )
    return issue_flags(counted, keep)


def element_text(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Description contents, then paragraph texts, joined by a blank, from the elements of :func:`page_elements`."""
    described = F.filter("elements", lambda e: (e["tag"] == "meta") & (_attr(e, "name") == "description"))
    texts = F.concat(
        F.transform(described, lambda e: _attr(e, "content")), F.transform(F.filter("elements", lambda e: e["tag"] == "p"), lambda e: e["text"])
    )
    return parsed.select(*keep, F.size(texts).alias("elements"), F.array_join(texts, " ").alias("text"))


def element_links(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, base_href, position, href, rel) of each link, as :func:`raw_links` gives them, from the elements of :func:`page_elements`."""
    of = lambda tag: F.filter("elements", lambda e: e["tag"] == tag)
    base = F.get(of("base"), F.lit(0))
    links = F.transform(of("a"), lambda e: F.struct(_attr(e, "href").alias("href"), _attr(e, "rel").alias("rel")))
    found = parsed.select(*keep, F.when(base.isNotNull(), _attr(base, "href")).alias("base_href"), links.alias("_links"))
    rows = unfold(found, [*keep, "base_href"], F.col("_links"), "_l", "position")
    return rows.select(*keep, "base_href", "position", F.col("_l.href").alias("href"), F.col("_l.rel").alias("rel"))


def raw_links(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """One row per ``<a>`` with its position, href and rel."""
    seen = pages.select(*keep, M.visible_markup(F.col(html)).alias("_m"))
    first_base = F.get(M.start_tags(F.col("_m"), "base"), F.lit(0))
    links = F.transform(
        M.start_tags(F.col("_m"), "a"), lambda t: F.struct(M.attribute(t, "href").alias("href"), M.attribute(t, "rel").alias("rel"))
    )
    # Everything is read off the markup before the explode, so no link row carries it.
    found = seen.select(*keep, F.when(first_base.isNotNull(), M.attribute(first_base, "href")).alias("base_href"), links.alias("_links"))
    rows = unfold(found, [*keep, "base_href"], F.col("_links"), "_l", "position")
    return rows.select(*keep, "base_href", "position", F.col("_l.href").alias("href"), F.col("_l.rel").alias("rel"))


def page_links(pages: DataFrame, keep: list[str], site_url: str, html: str = "html") -> DataFrame:
    """Normalised links of every page with their position and kind.

    Hrefs that start with ``#`` or ``javascript:`` are skipped (tested before
    trimming). An href without scheme hangs on the page's base, else on the site.
    """
    links = raw_links(pages, list(dict.fromkeys([*keep, site_url])), html)
    links = links.where(~F.col("href").startswith("#") & ~F.col("href").startswith("javascript:"))
    href = M.strip_space(F.col("href"))
    base = F.coalesce("base_href", site_url)
    absolute = F.when(U.has_scheme(href), href).otherwise(
        F.concat(U.trim_right_slashes(base), F.lit("/"), F.ltrim(href, F.lit("/")))
    )
    return (
        links.withColumn("_abs", absolute)
        .withColumn("url", U.normalize_url(F.col("_abs")))
        .withColumn("is_internal", U.is_internal(F.col("url"), F.col(site_url)))
        .withColumn("is_external", ~F.col("is_internal"))
        .select(*keep, "position", "url", "is_external", "is_internal")
    )


def sitemap_links(pages: DataFrame, keep: list[str], page_url: str, html: str = "html") -> DataFrame:
    """Unique resolved links without ``rel="nofollow"`` and blank hrefs."""
    links = raw_links(pages, list(dict.fromkeys([*keep, page_url])), html)
    kept = links.where((F.col("rel") != "nofollow") & ~F.col("href").isin("", "0"))
    return kept.select(*keep, U.resolve_url(F.col("href"), F.col(page_url)).alias("url")).distinct()


def updater_links(pages: DataFrame, keep: list[str], page_url: str, html: str = "html") -> DataFrame:
    """Links without anchors, scripts, mail and phone targets, resolved from the host root."""
    links = raw_links(pages, list(dict.fromkeys([*keep, page_url])), html)
    kept = links.where(~F.col("href").isin("", "0") & ~F.col("href").rlike(r"(?i)^(#|javascript:|mailto:|tel:)"))
    return kept.select(*keep, "position", U.resolve_url_from_root(F.col("href"), F.col(page_url)).alias("url"))


def link_counts(links: DataFrame, key: list[str], pages: DataFrame | None = None) -> DataFrame:
    """Internal and external links per page; with ``pages`` a page without links has none of both instead of no row."""
    counts = links.groupBy(*key).agg(
        F.count_if("is_internal").alias("internal_links"), F.count_if("is_external").alias("external_links")
    )
    if pages is None:
        return counts
    return pages.select(*key).distinct().join(counts, key, "left").na.fill(0, ["internal_links", "external_links"])


def links_column(links: DataFrame, key: list[str]) -> DataFrame:
    """The links of one page as an array of structs in page order."""
    entry = F.struct("position", F.struct(F.col("url").alias("URL"), F.col("is_external").alias("IsExternal"), F.col("is_internal").alias("IsInternal")).alias("link"))
    return links.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_l")).select(
        *key, F.transform("_l", lambda x: x["link"]).alias("links")
    )


def issue_flags(facts: DataFrame, keep: list[str]) -> DataFrame:
    """The ten flags from a page's counts of elements, first title and byte lengths."""
    has_title = F.col("_title") != ""
    rules = [
        F.col("_h1") == 0,
        F.col("_metas") == 0,
        ~has_title,
        F.col("_canonical") == 0,
        F.col("_meta_bytes") > MAX_DESCRIPTION,
        has_title & (F.col("_bytes") > MAX_TITLE),
        has_title & (F.col("_bytes") < MIN_TITLE),
        has_title & (F.col("_titles") > 1),
        F.col("_metas") > 1,
        F.col("_h1") > 1,
    ]
    return facts.select(*keep, *[r.cast("int").alias(n) for n, r in zip(ISSUES, rules)])


def page_issues(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Ten 0/1 flags per page; lengths are bytes of the decoded text."""
    head = pages.select(*keep, M.visible_markup(F.col(html)).alias("_m")).select(
        *keep, M.first_title(F.col("_m")).alias("_title"), M.start_tags(F.col("_m"), "h1|meta|link|title").alias("_tags")
    )

    def of(name: str) -> Column:
        return F.filter("_tags", lambda t: M.tag_is(t, name))

    described = F.filter(of("meta"), lambda t: M.attribute(t, "name") == "description")
    canonical = F.filter(
        of("link"), lambda t: (M.attribute(t, "rel") == "canonical") & (M.strip_space(M.attribute(t, "href")) != "")
    )
    facts = head.select(
        *keep,
        "_title",
        F.size(of("h1")).alias("_h1"),
        F.size(of("title")).alias("_titles"),
        F.size(described).alias("_metas"),
        F.octet_length(M.attribute(F.coalesce(F.get(described, F.lit(0)), F.lit("")), "content")).alias("_meta_bytes"),
        F.size(canonical).alias("_canonical"),
        F.octet_length("_title").alias("_bytes"),
    )
    return issue_flags(facts, keep)


def page_items(pages: DataFrame, issues: DataFrame, key: str, status: str, types: DataFrame) -> DataFrame:
    """Status item of every page and one item per raised flag, typed by name."""
    statuses = pages.select(key, F.col(status).cast("string").alias("issue"), F.col(status).cast("string").alias("note"))
    flagged = flags_to_items(issues, [key], ISSUES, status).withColumn("note", F.lit("1"))
    return type_lookup(statuses.unionByName(flagged), "issue", types)


def robots_sitemap_items(fetched: DataFrame, key: list[str], site_url: str) -> DataFrame:
    """Items for robots and sitemap responses, and the sitemap url to try next.

    ``fetched`` has kind (``robots`` or ``sitemap``), status and content.
    """
    from ..sources.readers import robots_sitemap

    found = robots_sitemap(F.col("content"))
    ok = F.col("status") == 200
    fallback = F.concat(U.normalize_url(F.col(site_url)), F.lit("/sitemap.xml"))
    robots = F.col("kind") == "robots"
    item = (
        F.when(robots & ok & (found == ""), SITEMAP_NOT_INDICATED)
        .when(robots & ~ok, ROBOTS_NOT_FOUND)
        .when((F.col("kind") == "sitemap") & ~ok, SITEMAP_NOT_FOUND)
    )
    next_url = F.when(robots & ok & (found != ""), found).when(robots, fallback)
    return fetched.select(*key, item.alias("item"), next_url.alias("next_url"))


def site_links(links: DataFrame, crawl: list[str], order: list[str]) -> DataFrame:
    """Distinct urls of a crawl with the flags of their first occurrence, not yet checked."""
    first = F.min_by(F.struct("is_internal", "is_external"), F.struct(*order))
    return links.groupBy(*crawl, "url").agg(first.alias("_f")).select(
        *crawl,
        "url",
        F.col("_f.is_internal").alias("is_internal"),
        F.col("_f.is_external").alias("is_external"),
        F.lit(False).alias("is_valid"),
        F.lit(0).alias("status_code"),
        F.lit(False).alias("is_analyzed"),
    )


def check_site_links(site: DataFrame, statuses: DataFrame, crawl: list[str]) -> DataFrame:
    """Set validity and status of the links that were fetched (unique per crawl and url)."""
    seen = statuses.select(*crawl, "url", F.col("status").alias("_s"))
    joined = site.join(seen, [*crawl, "url"], "left")
    fetched = F.col("_s").isNotNull()
    return joined.select(
        *crawl,
        "url",
        "is_internal",
        "is_external",
        F.when(fetched, U.link_is_valid(F.col("url"), F.col("_s"))).otherwise(F.col("is_valid")).alias("is_valid"),
        F.when(fetched, F.col("_s")).otherwise(F.col("status_code")).cast("int").alias("status_code"),
        (F.col("is_analyzed") | fetched).alias("is_analyzed"),
    )


def unchecked_links(site: DataFrame, crawl: list[str], order: list[str], cap: int | None = None) -> DataFrame:
    """The links of each crawl that were not analysed yet, numbered; the first ``cap`` when that is given."""
    return first_k_per_group(site.where(~F.col("is_analyzed")), crawl, order, ALL_ROWS if cap is None else cap)


def broken_links(links: DataFrame, site: DataFrame, page: list[str], crawl: list[str]) -> DataFrame:
    """Per page each distinct link whose site entry is not valid, with its status."""
    bad = site.where(~F.col("is_valid")).select(*crawl, "url", "status_code")
    distinct_links = links.select(*dict.fromkeys([*page, *crawl]), "url").distinct()
    return distinct_links.join(bad, [*crawl, "url"])


def page_text(pages: DataFrame, keep: list[str], html: str = "html", max_elements: int | None = None) -> DataFrame:
    """Description contents, then paragraph texts, joined by a blank.

    Every ``meta`` counts toward ``max_elements``; None takes all elements.
    """
    seen = pages.select(*keep, M.visible_markup(F.col(html)).alias("_m"))
    parsed = seen.select(*keep, M.start_tags(F.col("_m"), "meta").alias("_metas"), M.paragraphs(F.col("_m")).alias("_ps"))
    metas, ps = F.col("_metas"), F.col("_ps")
    if max_elements is not None:
        ps = F.slice(ps, F.lit(1), F.greatest(F.lit(max_elements) - F.size(metas), F.lit(0)))
        metas = F.slice(metas, 1, max_elements)
    descriptions = F.transform(
        F.filter(metas, lambda t: M.attribute(t, "name") == "description"), lambda t: M.attribute(t, "content")
    )
    texts = F.concat(descriptions, ps)
    return parsed.select(*keep, F.size(texts).alias("elements"), F.array_join(texts, " ").alias("text"))


def top_keywords(texts: DataFrame, site: list[str], text: str = "text", top: int = 15, longest: int = 3) -> DataFrame:
    """Most frequent lower-case terms of one to ``longest`` words per site.

    Terms are counted per text, summed per (site, term) with map-side combine, and
    only the first ``top`` per site leave a task. Whole texts are used. A task holds the terms of
    a bounded share of the texts, so more text means more tasks, not larger ones.
    """
    texts = by_bytes(cut_lineage(texts.select(*site, text)), text)
    words = F.filter(F.split(F.lower(clean_text(F.col(text), True, None)), " +"), lambda w: w != "")
    tokens = texts.select(*site, words.alias("_w1"))
    for n in range(2, longest + 1):
        tokens = NGram(n=n, inputCol="_w1", outputCol=f"_w{n}").transform(tokens)
    grams = F.concat(*[F.col(f"_w{n}") for n in range(1, longest + 1)])
    counted = unfold(tokens, site, grams, "term").groupBy(*site, "term").agg(F.count("*").alias("occurrence"))
    blanks = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit("")))
    counted = counted.withColumn("word_count", (blanks + 1).cast("int"))
    order = [F.desc("occurrence"), F.desc("word_count"), F.asc("term")]
    return first_k_per_group(counted, site, order, top, "row_no")


def external_link_facts(pages: DataFrame, site_col: str, page_url: str, order: list[str], html: str = "html", cap: int | None = None) -> DataFrame:
    """Distinct external links per site (the first ``cap`` when that is given) with the target's domain parts.

    Relative hrefs (no ``http`` anywhere) hang on the page url. Discovery order is
    ``order`` then the position on the page.
    """
    keep = list(dict.fromkeys([site_col, page_url, *order]))
    links = raw_links(pages, keep, html)
    href = F.when(F.contains("href", F.lit("http")), F.col("href")).otherwise(
        F.concat(U.trim_right_slashes(F.col(page_url)), F.lit("/"), F.ltrim(F.col("href"), F.lit("/")))
    )
    links = links.withColumn("href", href).where(U.link_kind(F.col("href"), F.col(page_url)) == "external")
    first = links.groupBy(site_col, F.col("href").alias("link_url")).agg(
        F.min(F.struct(*order, "position", F.col(page_url).alias("page_url"))).alias("_f")
    )
    capped = first_k_per_group(first, [site_col], ["_f", "link_url"], ALL_ROWS if cap is None else cap, "link_no")
    name, ext, base = U.domain_parts(F.col("link_url"))
    return capped.select(
        site_col, "link_no", "link_url", F.col("_f.page_url").alias("page_url"),
        name.alias("domain_name"), ext.alias("domain_ext"), base.alias("link_base_url"),
    )
