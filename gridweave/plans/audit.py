"""Site-audit queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl, matching, pages as P, score
from ..operators import sync
from ..sources.writers import sitemap_entries
from .common import sql_decode, sql_dots, sql_part, sql_sanitize, sql_trim, sql_visible, sql_www, table

# Item types of the audit (id, name, status).
ITEM_TYPES = [
    (1, "200 OK", "Information"),
    (2, "301 Moved Permanently", "Notice"),
    (3, "404 Not Found", "Issue"),
    (4, "500 Server Error", "Issue"),
    (5, "Title Tag Too Long", "Issue"),
    (6, "Title Tag Too Short", "Warning"),
    (7, "Missing H1 Heading", "Notice"),
    (8, "Missing Meta Description", "Notice"),
    (9, "Missing Title Tag", "Notice"),
    (10, "No Canonical Tag", "Notice"),
    (11, "Meta Description Too Long", "Notice"),
    (12, "Multiple Title Tags", "Notice"),
    (13, "Multiple Meta Descriptions", "Notice"),
    (14, "Multiple H1 Headings", "Notice"),
    (15, "Broken Link", "Issue"),
    (21, "Other", "Information"),
]
# Response status by url length, as the pages table has no status.
STATUSES = [200, 301, 404, 500, 403]


def item_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEM_TYPES, "type_id int, type_name string, status_name string")


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with host, site url and a derived status."""
    p = U.parts(F.col("url"))
    host = F.lower(p.host)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.length("url") % len(STATUSES) + 1)
    return table(spark, sf, "pages", True).select(
        "page_id", "url", "html", host.alias("site"),
        F.concat(p.scheme, F.lit("://"), U.with_www(host)).alias("site_url"), status.alias("status"),
    )


_HOST = f"lower({sql_part('url', 4)})"
_STATUS = f"list_extract([{', '.join(map(str, STATUSES))}], CAST(length(url) % {len(STATUSES)} AS INT) + 1)"
SITE_PAGES_SQL = (
    f"site_pages AS (SELECT page_id, url, html, {_HOST} AS site, {sql_part('url', 1)} || '://' || {sql_www(_HOST)} AS site_url, "
    f"{_STATUS} AS status FROM pages)"
)
_TITLE = sql_trim(sql_decode(r"regexp_extract(m, '(?is)<title[^>]*>(.*?)</title', 1)"))
ISSUES_SQL = f"""visible AS (SELECT page_id, url, site, site_url, status, {sql_visible('html')} AS m FROM site_pages),
facts AS (SELECT page_id, site, url, status, {_TITLE} AS title,
  len(regexp_extract_all(m, '(?i)<h1[\\s/>]')) AS h1s,
  len(regexp_extract_all(m, '(?i)<title[\\s/>]')) AS titles,
  list_filter(regexp_extract_all(m, '(?i)<meta\\s[^>]*>'), lambda t: regexp_matches(t, '\\sname="description"')) AS metas,
  len(list_filter(regexp_extract_all(m, '(?i)<link\\s[^>]*>'), lambda t: regexp_matches(t, 'rel="canonical"') AND regexp_matches(t, 'href="\\s*[^"\\s]'))) AS canon
  FROM visible),
issues AS (SELECT page_id, site, url, status,
  CAST(h1s = 0 AS INT) AS "Missing H1 Heading",
  CAST(len(metas) = 0 AS INT) AS "Missing Meta Description",
  CAST(title = '' AS INT) AS "Missing Title Tag",
  CAST(canon = 0 AS INT) AS "No Canonical Tag",
  CAST(coalesce(strlen({sql_decode("regexp_extract(metas[1], 'content=\"([^\"]*)\"', 1)")}), 0) > 160 AS INT) AS "Meta Description Too Long",
  CAST(title <> '' AND strlen(title) > 60 AS INT) AS "Title Tag Too Long",
  CAST(title <> '' AND strlen(title) < 30 AS INT) AS "Title Tag Too Short",
  CAST(title <> '' AND titles > 1 AS INT) AS "Multiple Title Tags",
  CAST(len(metas) > 1 AS INT) AS "Multiple Meta Descriptions",
  CAST(h1s > 1 AS INT) AS "Multiple H1 Headings" FROM facts)"""
_FLAG_LIST = ", ".join(f"{{'issue': '{n}', 'flag': \"{n}\"}}" for n in P.ISSUES)
TYPES_SQL = "types AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{s}')" for i, n, s in ITEM_TYPES) + ") t(type_id, type_name, status_name))"
ITEMS_SQL = f"""flagged AS (SELECT page_id, site, u.x.issue AS issue, '1' AS note FROM issues, unnest([{_FLAG_LIST}]) u(x) WHERE status <> 404 AND u.x.flag = 1),
raw_items AS (SELECT * FROM flagged UNION ALL SELECT page_id, site, CAST(status AS VARCHAR), CAST(status AS VARCHAR) FROM issues),
items AS (SELECT page_id, site, issue, note, coalesce((SELECT max(type_id) FROM types WHERE contains(lower(type_name), lower(issue))), 21) AS type_id FROM raw_items)"""
BASE_SQL = f"WITH {SITE_PAGES_SQL}, {ISSUES_SQL}, {TYPES_SQL}, {ITEMS_SQL}"


def page_issues(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_issues(site_pages(spark, sf), ["page_id", "site"])


PAGE_ISSUES_SQL = f"WITH {SITE_PAGES_SQL}, {ISSUES_SQL} SELECT * EXCLUDE (url, status) FROM issues"


# Markup put before each page by its id, and behind it; SQL has the same places as facts.
ODD_MARKUP = [
    ("", ""),
    ("<meta data-a='>' name=\"description\" content=\"1 > 0 &amp; more\">", ""),
    ("", "<!-- <h1>a</h1><title>b</title><link rel=canonical href=/c>"),
    ("<![CDATA[ > ]]><link title='>' rel=canonical href=\"/c?a=1>2\">", ""),
    (f"<meta name=description content='{'é' * 81}'>", ""),
    ("<meta name=description><meta name=\"description\" content=\"&eacute;\">", ""),
    ("<title> &#32;&Tab; </title>", ""),
    ("<title>&LongLeftRightArrow;&lt;b&gt; é</title>", ""),
    (f"<title>{'&eacute;' * 31}</title>", ""),
    ("<xmp>'<h1>' < 1; </xmps>", ""),
    ("<script>var a = '<h1>' < 1; </scripts></script><h1 title='>'>", ""),
    ("<p title='<h1>'><textarea><h1></textarea></p x='>'>", "<a href='open><h1>"),
]


def markup_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The flags and texts of pages with markup that only a tokenizer reads right."""
    at = (F.col("page_id") % len(ODD_MARKUP)).cast("int")
    part = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in ODD_MARKUP]), at + 1)
    odd = table(spark, sf, "pages", True).select("page_id", F.concat(part(0), "html", part(1)).alias("html"))
    return P.element_issues(P.page_elements(odd, ["page_id"]), ["page_id"])


MARKUP_ISSUES_SQL = f"""WITH {SITE_PAGES_SQL}, {ISSUES_SQL}, k AS (SELECT page_id, page_id % {len(ODD_MARKUP)} AS k, h1s, titles, strlen(title) AS n FROM facts),
f AS (SELECT page_id, k, CASE k WHEN 9 THEN 0 WHEN 10 THEN h1s + 1 ELSE h1s END AS h1s,
  CASE WHEN k IN (6, 7, 8) THEN titles + 1 WHEN k = 9 THEN 0 ELSE titles END AS titles, CASE k WHEN 6 THEN 0 WHEN 7 THEN 9 WHEN 8 THEN 62 WHEN 9 THEN 0 ELSE n END AS n,
  CASE WHEN k IN (1, 4) THEN 1 WHEN k = 5 THEN 2 ELSE 0 END AS metas FROM k)
SELECT page_id, CAST(h1s = 0 AS INT) AS "Missing H1 Heading", CAST(metas = 0 AS INT) AS "Missing Meta Description", CAST(n = 0 AS INT) AS "Missing Title Tag",
  CAST(k <> 3 AS INT) AS "No Canonical Tag", CAST(k = 4 AS INT) AS "Meta Description Too Long", CAST(n > 60 AS INT) AS "Title Tag Too Long",
  CAST(n BETWEEN 1 AND 29 AS INT) AS "Title Tag Too Short", CAST(n > 0 AND titles > 1 AS INT) AS "Multiple Title Tags",
  CAST(metas > 1 AS INT) AS "Multiple Meta Descriptions", CAST(h1s > 1 AS INT) AS "Multiple H1 Headings" FROM f"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    pages = site_pages(spark, sf)
    issues = P.page_issues(pages, ["page_id", "status"])
    return P.page_items(pages, issues, "page_id", "status", item_types(spark).select("type_id", "type_name"))


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("page_id", "issue", "note", "type_id")


PAGE_ITEMS_SQL = BASE_SQL + " SELECT page_id, issue, note, type_id FROM items"


def _stats(spark: SparkSession, sf: str, crawl_key: list[str]) -> DataFrame:
    """Findings per crawl, one crawl per ``crawl_key``; its id is the lowest page id."""
    pages = site_pages(spark, sf).withColumn("lang", F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1))
    slim = pages.select("page_id", *crawl_key)
    crawls = slim.groupBy(*crawl_key).agg(F.min("page_id").alias("crawl_id"), F.count("*").alias("pages_crawled"))
    crawls = crawls.withColumnRenamed("site", "website")
    owned = slim.join(
        crawls.select(F.col("website").alias("site"), *[k for k in crawl_key if k != "site"], "crawl_id"), crawl_key
    )
    counts = score.item_counts(_items(spark, sf), "page_id", item_types(spark))
    return score.crawl_stats(crawls.select("website", "crawl_id", "pages_crawled"), owned, counts, "page_id")


def site_score(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every site against all sites."""
    stats = _stats(spark, sf, ["site"])
    out = score.site_scores(stats, stats)
    return out.select(
        "website", "crawl_id", "pages_crawled", "issues", "warnings", "notices", "information",
        F.round("initial_score", 6).alias("initial_score"), "site_score",
    )


_SCORE_SQL = """, per_crawl AS (SELECT website, crawl_id, any_value(pages_crawled) AS pages_crawled,
  count(*) FILTER (status_name = 'Issue') AS issues, count(*) FILTER (status_name = 'Warning') AS warnings,
  count(*) FILTER (status_name = 'Notice') AS notices, count(*) FILTER (status_name = 'Information') AS information
  FROM crawls LEFT JOIN owned USING (crawl_id) LEFT JOIN items USING (page_id) LEFT JOIN types USING (type_id) GROUP BY ALL),
rated AS (SELECT *, issues::DOUBLE / pages_crawled AS ir, warnings::DOUBLE / pages_crawled AS wr, notices::DOUBLE / pages_crawled AS nr FROM per_crawl),
population AS ({population}),
lim AS (SELECT min(ir) i0, max(ir) i1, min(wr) w0, max(wr) w1, min(nr) n0, max(nr) n1 FROM population),
scored AS (SELECT r.*, coalesce((ir - i0) / nullif(i1 - i0, 0), 0) * 1.0 + coalesce((wr - w0) / nullif(w1 - w0, 0), 0) * 0.2
  + coalesce((nr - n0) / nullif(n1 - n0, 0), 0) * 0.1 AS initial FROM rated r, lim),
span AS (SELECT min(initial) lo, max(initial) hi FROM scored WHERE crawl_id IN (SELECT crawl_id FROM population))
SELECT website, crawl_id, pages_crawled, issues, warnings, notices, information, round(initial, 6) AS initial_score,
  CASE WHEN hi > lo THEN round(least(greatest(1.0 - (initial - lo) / (hi - lo), 0.0), 1.0) * 100, 2) END AS site_score FROM scored, span"""
SITE_SCORE_SQL = BASE_SQL + """, crawls AS (SELECT site AS website, min(page_id) AS crawl_id, count(*) AS pages_crawled FROM site_pages GROUP BY site),
owned AS (SELECT page_id, crawl_id FROM site_pages JOIN crawls ON site = website)""" + _SCORE_SQL.replace("{population}", "SELECT * FROM rated")


def site_score_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Every crawl (site and language) against the newest large crawl of each site."""
    stats = _stats(spark, sf, ["site", "lang"])
    crawls = stats.select(
        "website", "crawl_id", "pages_crawled", F.col("issues").alias("issues_found"),
        F.lit(True).alias("complete"), F.lit(False).alias("is_test"), F.lit("2024-07-01").cast("timestamp_ntz").alias("crawled_at"),
    )
    population = stats.join(score.latest_crawls(crawls).select("crawl_id"), "crawl_id", "left_semi")
    out = score.site_scores(population, stats)
    return out.select(
        "website", "crawl_id", "pages_crawled", "issues", "warnings", "notices", "information",
        F.round("initial_score", 6).alias("initial_score"), "site_score",
    )


SITE_SCORE_LATEST_SQL = BASE_SQL + r""", langs AS (SELECT page_id, site, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS lang FROM site_pages),
crawls AS (SELECT site AS website, lang, min(page_id) AS crawl_id, count(*) AS pages_crawled FROM langs GROUP BY site, lang),
owned AS (SELECT page_id, crawl_id FROM langs l JOIN crawls c ON site = website AND l.lang = c.lang)""" + _SCORE_SQL.replace(
    "{population}",
    "SELECT * FROM rated WHERE crawl_id IN (SELECT max(crawl_id) FROM rated WHERE pages_crawled > 5 AND issues > 2 GROUP BY website)",
)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_links(site_pages(spark, sf), ["page_id", "site", "site_url"], "site_url")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("page_id", "position", "url", "is_external", "is_internal")


_TAGS_SQL = f"""{SITE_PAGES_SQL}, vis AS (SELECT page_id, url, site, site_url, {sql_visible('html')} AS m FROM site_pages),
tags AS (SELECT page_id, url, site, site_url, unnest(t) AS tag, unnest(range(len(t))) AS position FROM (SELECT *, regexp_extract_all(m, '(?is)<a\\s[^>]*>') AS t FROM vis)),
hrefs AS (SELECT page_id, url, site, site_url, position, {sql_decode("regexp_extract(tag, '(?i)href=\"([^\"]*)\"', 1)")} AS href FROM tags)"""
LINKS_SQL = _TAGS_SQL + f""", links AS (SELECT page_id, site, site_url, CAST(position AS INT) AS position, link AS url, NOT starts_with(link, site_url) AS is_external,
  starts_with(link, site_url) AS is_internal FROM (SELECT *, {sql_sanitize("CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE site_url || '/' || ltrim(trim(href), '/') END")} AS link
  FROM hrefs WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')))"""
PAGE_LINKS_SQL = f"WITH {LINKS_SQL} SELECT page_id, position, url, is_external, is_internal FROM links"


def link_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.link_counts(_links(spark, sf), ["page_id"])


LINK_COUNTS_SQL = f"WITH {LINKS_SQL} SELECT page_id, count(*) FILTER (is_internal) AS internal_links, count(*) FILTER (is_external) AS external_links FROM links GROUP BY page_id"


def links_json(spark: SparkSession, sf: str) -> DataFrame:
    """Links as JSON text, decoded again to their urls."""
    from ..operators.reshape import links_from_json, links_to_json

    stored = P.links_column(_links(spark, sf), ["page_id"]).withColumn("links_json", links_to_json(F.col("links")))
    back = links_from_json(F.col("links_json"))
    return stored.select(
        "page_id", F.size(back).alias("links"), F.array_join(F.transform(back, lambda x: x["URL"]), " ").alias("urls")
    )


LINKS_JSON_SQL = f"WITH {LINKS_SQL} SELECT page_id, CAST(count(*) AS INT) AS links, string_agg(url, ' ' ORDER BY position) AS urls FROM links GROUP BY page_id"


def sitemap_page_links(spark: SparkSession, sf: str) -> DataFrame:
    return P.sitemap_links(table(spark, sf, "pages", True), ["page_id"], "url")


_BARE = "regexp_replace(lower(" + sql_part("url", 4) + "), '^www\\.', '')"
_PATH = sql_dots("regexp_extract(href, '^[^?#]*', 0)")
SITEMAP_PAGE_LINKS_SQL = f"""WITH {_TAGS_SQL} SELECT DISTINCT page_id, rtrim({sql_part('url', 1)} || '://www.' || {_BARE} || '/' || {_PATH}, '/') AS url
FROM hrefs WHERE href <> ''"""


def updater_links(spark: SparkSession, sf: str) -> DataFrame:
    return P.updater_links(table(spark, sf, "pages", True), ["page_id"], "url")


UPDATER_LINKS_SQL = f"""WITH {_TAGS_SQL} SELECT page_id, CAST(position AS INT) AS position,
rtrim({sql_part('url', 1)} || '://' || {sql_www(sql_part('url', 4))} || '/' || ltrim(array_to_string(list_filter(string_split(href, '/'), lambda p: p <> '..'), '/'), '/'), '/') AS url
FROM hrefs WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:)')"""


def _site_links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    links = _links(spark, sf)
    return links, P.site_links(links, ["site"], ["page_id", "position"])


def _fetched(site: DataFrame) -> DataFrame:
    """Derived responses: every link but those whose length ends in 0 was fetched."""
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.length("url") % len(STATUSES) + 1)
    return site.where(F.length("url") % 10 != 0).select("site", "url", status.alias("status"))


def site_links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links per site with their validity after checking."""
    _, site = _site_links(spark, sf)
    return P.check_site_links(site, _fetched(site), ["site"])


_LINK_STATUS = _STATUS
SITE_LINKS_CTE = f"""{LINKS_SQL}, firsts AS (SELECT site, url, arg_min(is_internal, page_id * 100000 + position) AS is_internal, arg_min(is_external, page_id * 100000 + position) AS is_external FROM links GROUP BY site, url),
site_links AS (SELECT site, url, is_internal, is_external, CASE WHEN length(url) % 10 = 0 THEN false ELSE {_LINK_STATUS} IN (200, 301, 302, 400, 403) OR regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|webp)(\\?.*)?$')
  OR regexp_matches(url, '(?i)mailto:') END AS is_valid, CASE WHEN length(url) % 10 = 0 THEN 0 ELSE {_LINK_STATUS} END AS status_code, length(url) % 10 <> 0 AS is_analyzed FROM firsts)"""
SITE_LINKS_SQL = f"WITH {SITE_LINKS_CTE} SELECT * FROM site_links"


def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    links, site = _site_links(spark, sf)
    checked = P.check_site_links(site, _fetched(site), ["site"])
    return P.broken_links(links, checked, ["page_id"], ["site"]).select("page_id", "site", "url", "status_code")


BROKEN_LINKS_SQL = f"WITH {SITE_LINKS_CTE} SELECT DISTINCT page_id, site, url, status_code FROM links JOIN site_links USING (site, url) WHERE NOT is_valid"


def unchecked_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links per site that still need a check, in url order."""
    _, site = _site_links(spark, sf)
    checked = P.check_site_links(site, _fetched(site), ["site"])
    return P.unchecked_links(checked, ["site"], ["url"]).select("site", "url", F.col("row_no").cast("bigint").alias("row_no"))


UNCHECKED_LINKS_SQL = f"WITH {SITE_LINKS_CTE} SELECT site, url, row_no FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY url) AS row_no FROM site_links WHERE NOT is_analyzed)"


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_text(table(spark, sf, "pages", True), ["page_id"], max_elements=None)


_BLOCKS = (
    "(?i)(</?(?:p|div|ul|ol|li|dl|dt|dd|table|tr|td|th|form|h[1-6]|hr|pre|blockquote|address"
    "|article|section|nav|header|footer|aside|main|body|html)(?:[\\s/>]))"
)
TEXTS_CTE = f"""{SITE_PAGES_SQL}, vis AS (SELECT page_id, site, {sql_visible('html')} AS m FROM site_pages),
ps AS (SELECT page_id, site, list_transform(list_filter(string_split(regexp_replace(m, '{_BLOCKS}', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)^<p[\\s/>]')),
  lambda x: {sql_trim(sql_decode("regexp_replace(x, '<[^>]*>', '', 'g')"))}) AS p FROM vis),
texts AS (SELECT page_id, site, CAST(len(p) AS INT) AS elements, array_to_string(p, ' ') AS text FROM ps)"""
PAGE_TEXT_SQL = f"WITH {TEXTS_CTE} SELECT page_id, elements, text FROM texts"


def site_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen most frequent terms of one to three words per site."""
    texts = P.page_text(site_pages(spark, sf), ["page_id", "site"], max_elements=None)
    return P.top_keywords(texts, ["site"]).select(
        "site", "term", "word_count", "occurrence", F.col("row_no").cast("bigint").alias("row_no")
    )


SITE_KEYWORDS_SQL = f"""WITH {TEXTS_CTE}, w AS (SELECT site, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')), ' +'), lambda x: x <> '') AS w FROM texts),
g AS (SELECT site, array_to_string(w[i:i + n - 1], ' ') AS term, n AS word_count FROM (SELECT site, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(n))),
c AS (SELECT site, term, word_count, count(*) AS occurrence FROM g GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY occurrence DESC, word_count DESC, term) AS row_no FROM c) WHERE row_no <= 15"""


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Link graph from page urls: site root -> each path prefix -> page."""
    p = U.parts(F.col("url"))
    home = F.concat(F.lit("https://www."), F.regexp_replace(F.lower(p.host), r"^www\.", ""))
    pages = table(spark, sf, "pages", True).select(home.alias("site"), F.split(F.trim(p.path, F.lit("/")), "/").alias("s"))
    steps = F.sequence(F.lit(1), F.size("s"))
    rows = pages.select("site", "s", F.explode(steps).alias("i"))
    prefix = lambda n: F.when(n == 0, F.col("site")).otherwise(
        F.concat("site", F.lit("/"), F.array_join(F.slice("s", F.lit(1), n), "/"))
    )
    edges = rows.select("site", prefix(F.col("i") - 1).alias("src"), prefix(F.col("i")).alias("dst"))
    return edges, pages.select("site", F.col("site").alias("url")).distinct()


def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """Depth and sitemap entry of every reachable url."""
    depths = crawl.crawl_depth(*_graph(spark, sf), max_urls=None)
    entries = sitemap_entries(depths, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return entries.join(depths.select(F.col("url").alias("loc"), "site", "depth"), "loc").select(
        "site", "loc", "depth", "lastmod", "changefreq", "priority", U.sitemap_priority_steps(F.col("depth")).alias("step_priority")
    )


SITEMAP_SQL = rf"""WITH RECURSIVE paths AS (SELECT 'https://www.' || {_BARE} AS site, string_split(trim({sql_part('url', 6)}, '/'), '/') AS s FROM pages),
rows AS (SELECT site, s, unnest(range(1, len(s) + 1)) AS i FROM paths),
edges AS (SELECT DISTINCT site, CASE WHEN i = 1 THEN site ELSE site || '/' || array_to_string(s[1:i - 1], '/') END AS src, site || '/' || array_to_string(s[1:i], '/') AS dst FROM rows),
walk(site, url, depth) AS (SELECT DISTINCT site, site, 0 FROM paths UNION SELECT w.site, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.site = e.site AND w.url = e.src WHERE w.depth < 50),
best AS (SELECT site, url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY site, url)
SELECT site, url AS loc, depth, '2024-01-20T00:00:00+00:00' AS lastmod, 'daily' AS changefreq,
  printf('%.4f', least(greatest(1.0 - ln(depth + 1.0) / ln(50.0), 0.1), 1.0)) AS priority,
  CASE WHEN depth < 1 THEN '1.0000' WHEN depth < 10 THEN '0.9500' WHEN depth < 30 THEN '0.8000' ELSE '0.7500' END AS step_priority FROM best"""


def sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    """The sitemap written as XML files and read back."""
    from ..session import work_path
    from ..sources.readers import read_sitemap
    from ..sources.writers import write_sitemap

    depths = crawl.crawl_depth(*_graph(spark, sf), max_urls=None)
    path = work_path(spark, "sitemap")
    write_sitemap(sitemap_entries(depths, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), path)
    return read_sitemap(spark, path)


SITEMAP_FILES_SQL = SITEMAP_SQL[: SITEMAP_SQL.rindex("SELECT site, url AS loc")] + "SELECT DISTINCT url AS loc FROM best"


def one_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """The website of the crawl that starts at page 0."""
    pages = site_pages(spark, sf).select("site", "page_id")
    crawls = pages.groupBy(F.col("site").alias("website")).agg(F.min("page_id").alias("crawl_id"), F.count("*").alias("pages"))
    return matching.one_crawl(pages.select(F.col("site").alias("website")).distinct(), crawls, 0)


ONE_CRAWL_SQL = f"WITH {SITE_PAGES_SQL} SELECT site AS website, min(page_id) AS crawl_id, count(*) AS pages FROM site_pages GROUP BY site HAVING min(page_id) = 0"


def normalized_urls(spark: SparkSession, sf: str) -> DataFrame:
    """All URL rules over five spellings of every page url."""
    pages = table(spark, sf, "pages", True)
    p = U.parts(F.col("url"))
    spellings = F.array(
        F.col("url"),
        F.concat(F.col("url"), F.lit("/a/../b/./c")),
        F.concat(p.host, p.path, F.lit("/../x//y")),
        F.concat(F.lit("mailto:info@"), p.host),
        F.concat(p.scheme, F.lit("://me:pw@"), p.host, F.lit(":8080"), p.path, F.lit("?q=für#t")),
    )
    rows = pages.select("page_id", F.posexplode(spellings).alias("kind", "u"))
    u = F.col("u")
    name, ext, base = U.domain_parts(u)
    has_host = U.url_host(u) != ""
    return rows.select(
        "page_id",
        "kind",
        U.normalize_url(u).alias("normalized"),
        U.ensure_www(u).alias("with_www"),
        U.remove_dot_segments(U.parts(u).path).alias("folded_path"),
        F.when(has_host, U.normalize_sitemap_url(u)).alias("sitemap_url"),
        F.when(has_host, name).alias("domain_name"),
        F.when(has_host, ext).alias("domain_ext"),
        U.is_valid_site_url(u, "example").alias("valid"),
        U.link_is_valid(u, F.lit(404)).alias("link_ok"),
    )


def _normalized_sql() -> str:
    n = lambda i: sql_part("s", i)
    u = lambda i: sql_part("u", i)
    host_ok = r"^https?://(?:[^/?#@]*@)?[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*\.?(?::\d+)?(?:[/?#].*)?$"

    def rebuild(f, host: str, path: str) -> str:
        opt = lambda pre, x, post="": f"CASE WHEN {x} <> '' THEN '{pre}' || {x} || '{post}' ELSE '' END"
        return " || ".join(
            [opt("", f(1), "://"), f(2), opt(":", f(3)), f"CASE WHEN {f(2)} <> '' THEN '@' ELSE '' END", f"({host})", opt(":", f(5)), f"({path})", opt("?", f(7)), opt("#", f(8))]
        )

    path = f"CASE WHEN regexp_matches(s, '{host_ok}') THEN {n(6)} ELSE {sql_dots(n(6))} END"
    p = lambda i: sql_part("url", i)
    return f"""WITH v AS (SELECT page_id, unnest([url, url || '/a/../b/./c', {p(4)} || {p(6)} || '/../x//y', 'mailto:info@' || {p(4)},
  {p(1)} || '://me:pw@' || {p(4)} || ':8080' || {p(6)} || '?q=für#t']) AS u, unnest(range(5)) AS kind FROM pages),
c AS (SELECT page_id, CAST(kind AS INT) AS kind, u, {sql_sanitize('u')} AS s FROM v)
SELECT page_id, kind, {rebuild(n, sql_www(n(4)), path)} AS normalized,
CASE WHEN {u(4)} = '' THEN u ELSE {rebuild(u, sql_www(u(4)), u(6))} END AS with_www,
{sql_dots(u(6))} AS folded_path,
CASE WHEN {u(4)} <> '' THEN {u(1)} || '://www.' || regexp_replace(lower({u(4)}), '^www\\.', '') || {u(6)} END AS sitemap_url,
CASE WHEN {u(4)} <> '' THEN string_split({u(4)}, '.')[-2] END AS domain_name,
CASE WHEN {u(4)} <> '' THEN string_split({u(4)}, '.')[-1] END AS domain_ext,
regexp_matches(u, '{host_ok}') AND contains({u(4)}, 'example') AS valid,
regexp_matches(u, '(?i)mailto:') AS link_ok FROM c"""


NORMALIZED_URLS_SQL = _normalized_sql()


def external_links(spark: SparkSession, sf: str) -> DataFrame:
    """External links per site with the id of the linked site; new sites get new ids.

    Pages get links to three foreign sites: one by their language, two fixed ones.
    """
    pages = site_pages(spark, sf)
    lang = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1)
    extra = F.concat(
        F.lit('<a href="https://shop.'), lang, F.lit('-news.org/a?x=1">n</a><a href="http://partner.net/p/'), F.col("page_id").cast("string"),
        F.lit('">p</a><a href="https://example.com/own">o</a>'),
    )
    linked = pages.withColumn("html", F.concat(extra, "html"))
    facts = P.external_link_facts(linked, "site", "url", ["page_id"]).withColumn("domain", F.concat_ws(".", "domain_name", "domain_ext"))
    known = spark.createDataFrame([(7, "partner.net")], "site_id int, domain string")
    numbered = facts.withColumn("_rank", F.ascii(F.substring("domain", 1, 1)) * 256 + F.ascii(F.substring("domain", 2, 1)))
    _, joined = sync.get_or_create_key(known, numbered, "domain", "site_id", "_rank")
    return joined.select(
        "site", "link_url", "page_url", "domain_name", "domain_ext", "link_base_url", F.col("site_id").alias("link_site_id"),
    )


EXTERNAL_LINKS_SQL = f"""WITH {SITE_PAGES_SQL}, l AS (SELECT page_id, site, url, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS lang FROM site_pages),
x AS (SELECT page_id, site, url, u.h AS link_url, u.pos AS pos FROM l, unnest([{{'h': 'https://shop.' || lang || '-news.org/a?x=1', 'pos': 0}}, {{'h': 'http://partner.net/p/' || page_id, 'pos': 1}}]) t(u)),
f AS (SELECT site, link_url, min(page_id * 10 + pos) AS k, arg_min(url, page_id * 10 + pos) AS page_url FROM x GROUP BY 1, 2),
c AS (SELECT *, regexp_extract(link_url, '//([^/]+)', 1) AS host FROM f),
d AS (SELECT *, string_split(host, '.')[-2] AS domain_name, string_split(host, '.')[-1] AS domain_ext FROM c),
n AS (SELECT domain_name || '.' || domain_ext AS dom, 7 + row_number() OVER (ORDER BY min(ascii(domain_name) * 256 + ascii(substr(domain_name, 2, 1))), domain_name || '.' || domain_ext) AS id
  FROM d WHERE domain_name <> 'partner' GROUP BY 1, domain_name, domain_ext)
SELECT site, link_url, page_url, domain_name, domain_ext, 'https://www.' || domain_name || '.' || domain_ext AS link_base_url,
CAST(coalesce((SELECT id FROM n WHERE dom = domain_name || '.' || domain_ext), 7) AS INT) AS link_site_id FROM d"""


def crawl_item_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl, page, item and type joined, pages without issue kept; counted per site and type."""
    pages = site_pages(spark, sf)
    crawls = pages.groupBy(F.col("site").alias("website")).agg(F.min("page_id").alias("crawl_id"))
    owned = pages.join(crawls, pages["site"] == crawls["website"]).select("page_id", "crawl_id")
    types = item_types(spark)
    only = _items(spark, sf).where("type_id = 5").select("page_id", "type_id")
    rows = matching.crawl_items(crawls, owned, only, types)
    return rows.groupBy("website", "type_name", "status_name").agg(F.count("*").alias("rows"))


CRAWL_ITEM_ROWS_SQL = BASE_SQL + """ SELECT site AS website, type_name, status_name, count(*) AS rows FROM site_pages p
LEFT JOIN (SELECT page_id, type_name, status_name FROM items JOIN types USING (type_id) WHERE type_id = 5) i USING (page_id) GROUP BY 1, 2, 3"""


def frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Urls to visit: page links and sitemap guesses of every site, without the stored pages."""
    pages = site_pages(spark, sf)
    found = P.page_links(pages, ["page_id"], "site_url").where("is_internal").select("url")
    guesses = pages.select(F.explode(F.array(*[F.concat("site_url", F.lit(x)) for x in ("/robots.txt", "/sitemap.xml")])).alias("url"))
    return matching.frontier(found, guesses, visited=pages.select(U.normalize_url(F.col("url")).alias("url")))


FRONTIER_SQL = f"""WITH {LINKS_SQL}, a AS (SELECT url FROM links WHERE is_internal UNION SELECT site_url || unnest(['/robots.txt', '/sitemap.xml']) FROM site_pages)
SELECT url FROM a WHERE url NOT IN (SELECT site_url || regexp_replace(url, '^[a-z]+://[^/]+', '') FROM site_pages)"""


def robots_items(spark: SparkSession, sf: str) -> DataFrame:
    """Robots and sitemap responses of every page's site, derived from the pages."""
    pages = site_pages(spark, sf)
    named = F.when(F.length("url") % 2 == 0, F.concat(F.lit("User-agent: *\r\n  Sitemap:  "), "site_url", F.lit("/map.xml \nSitemap: /second"))).otherwise(
        F.concat(F.lit("User-agent: *\nsitemap: /lower\n# "), "url")
    )
    fetched = pages.select(
        "page_id", "site_url", "status", named.alias("content"), F.explode(F.array(F.lit("robots"), F.lit("sitemap"))).alias("kind")
    )
    return P.robots_sitemap_items(fetched, ["page_id", "kind"], "site_url")


ROBOTS_ITEMS_SQL = f"""WITH {SITE_PAGES_SQL}, k AS (SELECT *, unnest(['robots', 'sitemap']) AS kind, length(url) % 2 = 0 AS has FROM site_pages)
SELECT page_id, kind, CASE WHEN kind = 'robots' AND status = 200 AND NOT has THEN 'Sitemap Not Indicated in Robots.txt' WHEN kind = 'robots' AND status <> 200 THEN 'Robots.txt Not Found'
WHEN kind = 'sitemap' AND status <> 200 THEN 'Sitemap Not Found' END AS item,
CASE WHEN kind = 'robots' THEN CASE WHEN status = 200 AND has THEN site_url || '/map.xml' ELSE site_url || '/sitemap.xml' END END AS next_url FROM k"""


QUERIES = {
    "site_score": site_score,
    "site_score_latest": site_score_latest,
    "page_issues": page_issues,
    "markup_issues": markup_issues,
    "page_items": page_items,
    "page_links": page_links,
    "link_counts": link_counts,
    "links_json": links_json,
    "sitemap_page_links": sitemap_page_links,
    "updater_links": updater_links,
    "site_links": site_links,
    "broken_links": broken_links,
    "unchecked_links": unchecked_links,
    "page_text": page_text,
    "site_keywords": site_keywords,
    "sitemap": sitemap,
    "normalized_urls": normalized_urls,
    "external_links": external_links,
    "crawl_item_rows": crawl_item_rows,
    "frontier": frontier,
    "sitemap_files": sitemap_files,
    "one_crawl": one_crawl,
    "robots_items": robots_items,
}
ORACLES = {
    "site_score": SITE_SCORE_SQL,
    "site_score_latest": SITE_SCORE_LATEST_SQL,
    "page_issues": PAGE_ISSUES_SQL,
    "markup_issues": MARKUP_ISSUES_SQL,
    "page_items": PAGE_ITEMS_SQL,
    "page_links": PAGE_LINKS_SQL,
    "link_counts": LINK_COUNTS_SQL,
    "links_json": LINKS_JSON_SQL,
    "sitemap_page_links": SITEMAP_PAGE_LINKS_SQL,
    "updater_links": UPDATER_LINKS_SQL,
    "site_links": SITE_LINKS_SQL,
    "broken_links": BROKEN_LINKS_SQL,
    "unchecked_links": UNCHECKED_LINKS_SQL,
    "page_text": PAGE_TEXT_SQL,
    "site_keywords": SITE_KEYWORDS_SQL,
    "sitemap": SITEMAP_SQL,
    "normalized_urls": NORMALIZED_URLS_SQL,
    "external_links": EXTERNAL_LINKS_SQL,
    "crawl_item_rows": CRAWL_ITEM_ROWS_SQL,
    "frontier": FRONTIER_SQL,
    "sitemap_files": SITEMAP_FILES_SQL,
    "one_crawl": ONE_CRAWL_SQL,
    "robots_items": ROBOTS_ITEMS_SQL,
}
