"""Section, text, matching and comparison queries.

A conversation stands for a chapter, a turn for a section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import matching as J
from ..operators import ordering as O
from ..operators import reshape as R
from ..operators.diff import discrepancy_rollup, table_diff
from ..operators.sections import important_chapter, target_words
from .common import table

WORDS_PER_CHAPTER = 2000


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections in order with their number and size of chapter; system turns count as empty."""
    c = table(spark, sf, "conversations")
    rows = c.select(
        F.col("conv_id").alias("chapter"), (F.col("turn") + 1).alias("section"),
        F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text")).alias("content"),
    )
    return O.number_rows(rows, ["section"], ["chapter"], row_no="row_no", group_rows="group_rows")


_S = """s AS (SELECT conv_id AS chapter, turn + 1 AS section, CASE WHEN role = 'system' THEN '' ELSE text END AS content FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY section) AS row_no, count(*) OVER (PARTITION BY chapter) AS group_rows FROM s)"""


def section_context(spark: SparkSession, sf: str) -> DataFrame:
    """Last two non-empty earlier sections of the chapter, and the end-of-chapter flag."""
    got = O.previous_rows(_sections(spark, sf), ["chapter"], "content", 2, "\n\n---\n\n", "recent")
    return got.select(
        "chapter", "section", O.is_last_in_group().alias("is_last"),
        F.coalesce("recent", F.lit("No prior sections yet for this chapter.")).alias("recent"),
    )


SECTION_CONTEXT_SQL = f"""WITH {_S}, f AS (SELECT chapter, section, content, row_number() OVER (PARTITION BY chapter ORDER BY section DESC) AS r FROM s WHERE content <> '')
SELECT chapter, section, row_no = group_rows AS is_last, coalesce((SELECT string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY section)
FROM (SELECT content, section FROM f WHERE f.chapter = n.chapter AND f.section < n.section ORDER BY section DESC LIMIT 2)), 'No prior sections yet for this chapter.') AS recent FROM n"""


def section_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Running section number and word total over all chapters, progress and check flag."""
    s = _sections(spark, sf).withColumn("words", X.word_count(F.col("content")))
    run = O.number_rows(s, ["chapter", "section"], None, {"total_words": "words"}, "sequence", "all_sections")
    return run.select(
        "chapter", "section", "sequence", "words", F.col("total_words").cast("bigint").alias("total_words"),
        F.round(F.col("sequence") * 100.0 / F.col("all_sections")).cast("int").alias("progress"),
        O.every_nth_or_last(3, "sequence", O.is_last_in_group()).alias("check_due"),
    )


_WORDS = r"len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))"
SECTION_PROGRESS_SQL = f"""WITH {_S}, w AS (SELECT *, CAST({_WORDS} AS INT) AS words, row_number() OVER (ORDER BY chapter, section) AS sequence, count(*) OVER () AS all_sections FROM n)
SELECT chapter, section, sequence, words, CAST(sum(words) OVER (ORDER BY sequence) AS BIGINT) AS total_words, CAST(round(sequence * 100.0 / all_sections) AS INT) AS progress,
sequence % 3 = 0 OR row_no = group_rows AS check_due FROM w"""


def section_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Target words, quality score and display bands of every section."""
    s = _sections(spark, sf).withColumn("words", X.word_count(F.col("content")))
    chapters = s.agg(F.max("chapter").alias("m")).scalar()
    s = s.withColumn("chapters", chapters).withColumn(
        "important", important_chapter(F.col("chapter"), F.col("chapters"), F.lit(None).cast("string"))
    )
    target = target_words(F.lit(WORDS_PER_CHAPTER), F.col("group_rows"), F.col("section"), F.col("important"))
    s = s.withColumn("target", target).withColumn("quality", X.text_quality(F.col("content"), F.col("target"), F.col("words")))
    return s.select(
        "chapter", "section", "words", "target", "quality", "important",
        V.word_count_band(F.col("words"), F.col("target")).alias("length_band"), V.score_band(F.col("quality")).alias("score_band"),
    )


_SENSES = " + ".join(f"CAST(regexp_matches(content, '(?i){w}') AS INT)" for w in X.SENSE_WORDS)
SECTION_QUALITY_SQL = rf"""WITH {_S}, a AS (SELECT *, CAST({_WORDS} AS INT) AS words, (SELECT max(chapter) FROM s) AS m FROM n),
b AS (SELECT *, chapter = 1 OR chapter = m OR chapter IN (floor(m * 0.25), floor(m * 0.25) + 1, floor(m * 0.75), floor(m * 0.75) + 1, floor(m * 0.5), floor(m * 0.5) + 1) AS important FROM a),
t1 AS (SELECT *, CAST(floor({WORDS_PER_CHAPTER} / group_rows) AS BIGINT) AS t FROM b),
t2 AS (SELECT * EXCLUDE (t), CASE WHEN important THEN CAST(floor(t * 1.2::DOUBLE) AS BIGINT) ELSE t END AS t FROM t1),
t3 AS (SELECT * EXCLUDE (t), CASE WHEN section = 1 THEN CAST(floor(t * 1.1::DOUBLE) AS BIGINT) WHEN section = group_rows THEN CAST(floor(t * 0.9::DOUBLE) AS BIGINT) ELSE t END AS target FROM t2),
q AS (SELECT *, words::DOUBLE / target AS r, list_filter(string_split(content, chr(10)), lambda p: regexp_matches(p, '\S')) AS ps FROM t3),
z AS (SELECT *, CAST(greatest(0, least(100, 80 + CASE WHEN r BETWEEN 0.9 AND 1.1 THEN 10 WHEN r BETWEEN 0.8 AND 1.2 THEN 5 WHEN r < 0.7 OR r > 1.3 THEN -10 ELSE 0 END
 + CASE WHEN contains(content, '"') THEN 5 ELSE 0 END + CASE WHEN len(ps) >= 5 THEN 5 ELSE 0 END - CASE WHEN len(list_filter(ps, lambda p: length(p) > 1000)) > 0 THEN 5 ELSE 0 END
 + least(10, 2 * ({_SENSES})))) AS INT) AS quality FROM q)
SELECT chapter, section, words, target, quality, important, CASE WHEN words < target * 0.8::DOUBLE THEN 'short' WHEN words > target * 1.2::DOUBLE THEN 'long' ELSE 'on target' END AS length_band,
CASE WHEN quality < 70 THEN 'low' WHEN quality >= 90 THEN 'high' ELSE 'medium' END AS score_band FROM z"""


def chapter_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole chapter texts in section order, in parts of at most 1000 sections."""
    got = O.ordered_text(_sections(spark, sf), ["chapter"], F.concat("content", F.lit("\n\n")), "")
    return got.select("chapter", "part_no", "rows", "text")


CHAPTER_TEXT_SQL = f"""WITH {_S} SELECT chapter, (row_no - 1) // 1000 AS part_no, count(*) AS rows, string_agg(content || chr(10) || chr(10), '' ORDER BY section) AS text FROM n GROUP BY 1, 2"""


def chapter_context(spark: SparkSession, sf: str) -> DataFrame:
    """Opening sections of the two chapters before, by chapter number."""
    s = _sections(spark, sf)
    first = s.where("section = 1").select("chapter", F.col("content").alias("summary")).where("summary <> ''")
    got = O.previous_by_value(first, "chapter", "summary", 2, "context")
    return got.select("chapter", F.coalesce("context", F.lit("This is the first chapter.")).alias("context"))


CHAPTER_CONTEXT_SQL = f"""WITH {_S}, f AS (SELECT chapter, content FROM s WHERE section = 1 AND content <> '')
SELECT chapter, coalesce((SELECT string_agg('Chapter ' || g.chapter || ': ' || g.content, chr(10) ORDER BY g.chapter) FROM f g WHERE g.chapter BETWEEN f.chapter - 2 AND f.chapter - 1), 'This is the first chapter.') AS context FROM f"""


def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with text per chapter, at least 1, and the mean length."""
    s = _sections(spark, sf).withColumn("words", X.word_count(F.col("content")))
    return s.groupBy("chapter").agg(
        F.greatest(F.count_if(F.col("content") != ""), F.lit(1)).alias("sections"),
        F.round(F.avg("words")).cast("int").alias("mean_words"),
    )


SECTION_COUNTS_SQL = f"""WITH {_S} SELECT chapter, greatest(count(*) FILTER (content <> ''), 1) AS sections, CAST(round(avg({_WORDS})) AS INT) AS mean_words FROM n GROUP BY chapter"""


def first_last_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Opening text of chapter 1 and of the last chapter, per role."""
    c = table(spark, sf, "conversations").select("role", F.col("conv_id").alias("chapter"), F.lit(1).alias("section"), F.col("turn").alias("seq"), F.col("text").alias("summary"))
    return O.first_last_summary(c, "chapter", "section", "seq", "summary", ["role"])


FIRST_LAST_SQL = """SELECT role, max(CASE WHEN conv_id = 1 THEN f END) AS first_summary, arg_max(f, conv_id) AS last_summary, max(conv_id) AS last_chapter
FROM (SELECT role, conv_id, arg_min(text, turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY role"""


def outline_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines (one per turn) as JSON, taken apart into numbered sections."""
    c = table(spark, sf, "conversations")
    people = F.array(F.col("role"), F.lit("narrator"))
    one = F.struct(
        (F.col("turn") * 2 + 1).cast("int").alias("section_number"), F.col("text").alias("summary"),
        people.alias("characters_present"), F.array(F.lit("a"), F.lit("b")).alias("key_plot_points"),
        F.lit("here").alias("setting"), F.lit("Climax").alias("story_arc_position"),
    )
    doc1 = F.to_json(one)
    two = F.struct(
        (F.col("turn") * 2 + 2).cast("int").alias("section_number"),
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role")).alias("summary"),
        F.col("role").alias("characters_present"), F.lit("one point").alias("key_plot_points"),
        F.lit("there").alias("setting"), F.lit("Midpoint").alias("story_arc_position"),
    )
    doc = F.concat(F.lit('{"chapter_number":'), F.col("conv_id").cast("string"), F.lit(',"sections":['), doc1, F.lit(","), F.to_json(two), F.lit("]}"))
    return R.explode_sections(c.select("turn", doc.alias("outline")), "outline", "turn")


OUTLINE_SECTIONS_SQL = """WITH r AS (SELECT conv_id, turn, 0 AS p, text AS summary, role || ', narrator' AS characters, 'a; b' AS plot_points, 'here' AS setting, 'Climax' AS arc_position FROM conversations
UNION ALL SELECT conv_id, turn, 1, role, role, 'one point', 'there', 'Midpoint' FROM conversations WHERE role <> 'user')
SELECT CAST(conv_id AS INT) AS chapter, CAST(turn * 2 + 1 + p AS INT) AS section, summary, characters, plot_points, setting, arc_position, row_number() OVER (ORDER BY conv_id, turn, p) AS sequence
FROM r WHERE conv_id <> 0 AND summary <> ''"""


# ---------------------------------------------------------------- matching

# Client list of the title match (client, keyword, position).
CLIENTS = [("Acme", "license", 1), ("Blank", "", 2), ("Beta", "ENERUNG", 3), ("Delta", "éeau", 4), ("Gamma", "tion", 5), ("Omega", "zzzz", 6)]


def first_client(spark: SparkSession, sf: str) -> DataFrame:
    clients = spark.createDataFrame(CLIENTS, "client string, keyword string, position int")
    docs = table(spark, sf, "documents", True).select("doc_id", "text")
    return J.first_keyword_match(docs, "doc_id", F.col("text"), clients).select("doc_id", "client")


FIRST_CLIENT_SQL = "SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(lower(text), lower('{k}')) THEN '{c}'" for c, k, _ in CLIENTS if k
) + " ELSE '' END AS client FROM documents"


def mentioned_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose name contains a word that a part lists (its colour and its type)."""
    p = table(spark, sf, "part")
    listed = p.select("p_partkey", F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" ,, "), "p_type").alias("listed"))
    return J.mention_join(listed, "p_partkey", "listed", p.select("p_name"), "p_name")


MENTIONED_PARTS_SQL = """WITH l AS (SELECT DISTINCT p_partkey, lower(trim(unnest([split_part(p_name, ' ', 1), p_type]))) AS w FROM part), n AS (SELECT DISTINCT p_name FROM part)
SELECT DISTINCT p_partkey, p_name FROM l JOIN n ON contains(lower(p_name), w)"""


def new_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Set operations: customers without order, and how many have one, per segment."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    none = J.not_in(c, o, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("without"))
    some = J.known_rows(c, o, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("with_orders"))
    return some.join(none, "c_mktsegment", "left").select("c_mktsegment", "with_orders", F.coalesce("without", F.lit(0)).alias("without"))


NEW_CUSTOMERS_SQL = """SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders,
count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without FROM customer GROUP BY 1"""


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Active customers (spaces) x order rows (members) x suppliers as users with valid addresses."""
    spaces = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_active")).select(
        F.concat(F.lit("spaces/"), "o_custkey").alias("name"), F.lit("").alias("display_name"), "last_active"
    )
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    members = li.select(
        F.concat(F.lit("spaces/"), "o_custkey").alias("space"), F.concat(F.lit("users/"), "l_suppkey").alias("member"),
        F.when(F.col("l_returnflag") == "R", "BOT").otherwise("HUMAN").alias("member_type"),
    ).distinct()
    mail = F.when(F.col("s_nationkey") == 0, F.lit("no address")).otherwise(F.concat(F.lit("s"), "s_suppkey", F.lit("@mail.example")))
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("user_id"), mail.alias("email"))
    since = F.lit("2000-01-01").cast("timestamp_ntz")
    return J.membership_fanout(spaces, members, users, since)


MEMBERSHIP_SQL = """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS space_id, 'Unnamed Space' AS space_name, CAST(l_suppkey AS VARCHAR) AS user_id, 's' || l_suppkey || '@mail.example' AS email
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag <> 'R' AND s_nationkey <> 0 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '2000-01-01')"""


def _books(spark: SparkSession, sf: str):
    """A main workbook over all customers and one workbook per nation."""
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("book"))
    c = table(spark, sf, "customer")
    main = F.lit("main")
    config = n.select("book", F.lit("Y").alias("compare"), F.lit("N").alias("main")).unionByName(
        spark.createDataFrame([("main", "Y", "Y"), ("idle", "N", "N")], "book string, compare string, main string")
    )
    k = F.col("n_nationkey")
    tabs = F.array(F.lit("customers"), F.when(k % 2 == 0, F.lit("parts")), F.when(k % 3 == 0, F.lit("scratch")))
    tables = n.select("book", F.explode(F.array_compact(tabs)).alias("tab")).unionByName(
        spark.createDataFrame([("main", "customers"), ("main", "parts")], "book string, tab string")
    )
    heads = F.array(F.lit("name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("segment")).otherwise(F.lit("Segment")), F.lit("balance"),
                    F.when(F.col("n_nationkey") % 5 == 0, F.lit("note")).otherwise(F.lit("")))
    headers = n.select("book", F.lit("customers").alias("tab"), F.posexplode(heads).alias("col_idx", "header")).unionByName(
        spark.createDataFrame([("main", "customers", i, h) for i, h in enumerate(["name", "segment", "balance"])], "book string, tab string, col_idx int, header string")
    )
    line = F.array(F.concat(F.lit("="), "c_mktsegment"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")), F.col("c_acctbal").cast("string"))
    own = O.number_rows(c, ["c_custkey"], ["c_nationkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("book", "row_no", F.posexplode(line).alias("col_idx", "cell"))
    whole = O.number_rows(c, ["c_custkey"]).select(main.alias("book"), "row_no", F.posexplode(line).alias("col_idx", "cell"))
    cells = own.unionByName(whole).withColumn("tab", F.lit("customers"))
    return tables, headers, cells, config


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return table_diff(*_books(spark, sf), first_rows=5)


def workbook_diff(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform("formula_mismatches", lambda x: F.concat_ws("|", x["row_number"].cast("string"), x["main_formula"], x["other_formula"]))
    return _diff(spark, sf).select(
        "book", "tab", "type", "column_letter", "main_header", "other_header", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("cells"), "issues"
    )


_DIFF = """WITH n AS (SELECT n_nationkey AS k, n_name AS book FROM nation),
m AS (SELECT row_number() OVER (ORDER BY c_custkey) AS r, c_mktsegment, c_name, c_acctbal FROM customer QUALIFY r <= 5),
o AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c_mktsegment, c_name, c_acctbal FROM customer QUALIFY r <= 5),
mf AS (SELECT r, 0 AS col, '=' || c_mktsegment AS f FROM m UNION ALL SELECT r, 1, '=' || c_name FROM m WHERE c_acctbal > 5000),
ofs AS (SELECT k, r, 0 AS col, '=' || c_mktsegment AS f FROM o UNION ALL SELECT k, r, 1, '=' || c_name FROM o WHERE c_acctbal > 5000),
pairs AS (SELECT n.k, n.book, x.r, x.col FROM n, (SELECT r, col FROM mf) x UNION SELECT k, book, r, col FROM ofs JOIN n USING (k)),
cells AS (SELECT p.book, p.k, p.col, p.r, coalesce(mf.f, '(no formula)') AS a, coalesce(ofs.f, '(no formula)') AS b FROM pairs p LEFT JOIN mf ON mf.r = p.r AND mf.col = p.col
  LEFT JOIN ofs ON ofs.k = p.k AND ofs.r = p.r AND ofs.col = p.col WHERE mf.f IS DISTINCT FROM ofs.f),
heads AS (SELECT book, k, 1 AS col, 'segment' AS a, 'Segment' AS b FROM n WHERE k % 2 = 1 UNION ALL SELECT book, k, 3, '(missing)', 'note' FROM n WHERE k % 5 = 0),
groups AS (SELECT book, k, col, max(a) AS mh, max(b) AS oh, NULL AS cells, 0 AS c FROM heads GROUP BY 1, 2, 3 UNION ALL
  SELECT book, k, col, NULL, NULL, string_agg((r + 1) || '|' || a || '|' || b, ';' ORDER BY r), count(*) FROM cells GROUP BY 1, 2, 3),
d AS (SELECT book, 'customers' AS tab, 'columnGroup' AS type, chr(65 + col) AS column_letter, max(mh) AS main_header, max(oh) AS other_header, coalesce(max(cells), '') AS cells,
  CAST(sum(c) + max(CASE WHEN mh IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS issues FROM groups GROUP BY book, col
UNION ALL SELECT book, 'parts', 'missingTab', NULL, NULL, NULL, '', 1 FROM n WHERE k % 2 <> 0
UNION ALL SELECT book, 'scratch', 'extraTab', NULL, NULL, NULL, '', 1 FROM n WHERE k % 3 = 0)"""
WORKBOOK_DIFF_SQL = _DIFF + " SELECT * FROM d"


def diff_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return discrepancy_rollup(_diff(spark, sf))


DIFF_ROLLUP_SQL = _DIFF + """ SELECT book, tab, column_letter, CAST(grouping(book, tab, column_letter) AS INT) AS level, count(*) AS discrepancies, CAST(sum(issues) AS BIGINT) AS issues
FROM d GROUP BY ROLLUP (book, tab, column_letter) HAVING grouping(book, tab, column_letter) <> 7"""


# ---------------------------------------------------------------- text and JSON

# Keyword lists of the channel filter.
ANY_OF, NONE_OF, INCLUDE = ["tion", "que"], ["license", "copyright"], ["mail", "src1"]


def filtered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that pass the keyword lists, with the first e-mail address."""
    d = table(spark, sf, "documents", True)
    kept = d.where(X.keyword_filter(F.col("text"), ANY_OF, NONE_OF)).where(X.contains_any(F.col("source"), INCLUDE) | X.contains_any(F.col("text"), INCLUDE))
    email = X.extract_email(F.col("source"), F.col("text"))
    return kept.select("doc_id", email.alias("email"), X.valid_email(email).alias("valid"))


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


FILTERED_DOCUMENTS_SQL = rf"""SELECT doc_id, e AS email, regexp_matches(e, '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS valid FROM (SELECT *, regexp_extract(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}', 0) AS e FROM documents)
WHERE {_any('text', ANY_OF)} AND NOT {_any('text', NONE_OF)} AND ({_any('source', INCLUDE)} OR {_any('text', INCLUDE)})"""


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts without special characters, with their word count."""
    clean = X.clean_text(F.col("text"), True, None)
    return table(spark, sf, "documents", True).select("doc_id", clean.alias("clean"), X.word_count(F.col("text")).alias("words"))


CLEAN_DOCUMENTS_SQL = r"""SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS clean, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS words FROM documents"""


def repaired_json(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties damaged on purpose, repaired and parsed."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    bad = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(F.col("event_type") == "view", F.concat(F.lit("{k: "), k, F.lit(", // the key\n}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"k" '), F.lit('["'), k, F.lit('", /* last */ ],}')))
        .otherwise(F.col("props"))
    )
    fixed = X.repair_json(bad)
    return e.select("event_id", fixed.alias("fixed"), F.try_variant_get(F.try_parse_json(fixed), "$.k", "string").alias("k"), X.extract_json_object(bad).alias("object"))


REPAIRED_JSON_SQL = r"""WITH e AS (SELECT event_id, event_type, props, regexp_extract(props, '(\d+)', 1) AS n FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN '{"k": ' || n || ' ' || chr(10) || '}' WHEN 'error' THEN '{"k" :["' || n || '"  ]}' ELSE props END AS fixed,
CASE event_type WHEN 'error' THEN '["' || n || '"]' ELSE n END AS k,
CASE event_type WHEN 'view' THEN '{k: ' || n || ', // the key' || chr(10) || '}' WHEN 'error' THEN '{"k" ["' || n || '", /* last */ ],}' ELSE props END AS object FROM e"""


def typed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Structured answers of every output type; errors are answers that do not parse."""
    e = table(spark, sf, "events")
    broken = F.col("event_type") == "error"
    v = F.col("value").cast("string")
    one = F.when(broken, F.lit("no {json")).otherwise(F.concat(F.lit('{"value": '), v, F.lit(', "currency": "USD"}')))
    many = F.when(broken, F.lit("no {json")).otherwise(F.concat(F.lit('{"value": ["'), "event_type", F.lit('", "x"]}')))
    word = F.concat(F.lit('{"value": "'), "event_type", F.lit('"}'))
    return e.select(
        "event_id",
        X.parse_typed(one, "number").alias("number"), X.parse_typed(one, "currency").alias("currency"),
        X.parse_typed(many, "list").alias("listed"), X.parse_typed(many, "multioptions:click,x").alias("multi"),
        X.parse_typed(word, "options:click,view").alias("option"), X.parse_typed(word, "text").alias("raw"),
    )


TYPED_ANSWERS_SQL = r"""WITH e AS (SELECT event_id, event_type AS t, regexp_replace(CAST(value AS VARCHAR), '\.0$', '') AS v FROM events)
SELECT event_id, CASE WHEN t = 'error' THEN 'no {json' ELSE v END AS number, CASE WHEN t = 'error' THEN 'no {json' ELSE 'USD ' || v END AS currency,
CASE WHEN t = 'error' THEN 'no {json' ELSE t || ', x' END AS listed, CASE WHEN t = 'error' THEN 'no {json' ELSE t || ', x' END AS multi, t AS option, '{"value": "' || t || '"}' AS raw FROM e"""


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The registered SQL functions over whole texts."""
    from ..functions.registry import register_functions

    register_functions(spark)
    return spark.sql(
        "SELECT doc_id, gw_word_count(text) AS words, gw_email(source, text) AS email, gw_first_text('', source) AS shown, "
        "gw_resource_id(concat('sources/', source)) AS source_id, gw_valid_email(lang) AS valid FROM {d}",
        d=table(spark, sf, "documents", True),
    )


SQL_FUNCTIONS_SQL = r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS words,
regexp_extract(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', 0) AS email, source AS shown, source AS source_id, false AS valid FROM documents"""


_NAMES = (
    "section_context:SECTION_CONTEXT_SQL section_progress:SECTION_PROGRESS_SQL section_quality:SECTION_QUALITY_SQL chapter_text:CHAPTER_TEXT_SQL "
    "chapter_context:CHAPTER_CONTEXT_SQL section_counts:SECTION_COUNTS_SQL first_last_summary:FIRST_LAST_SQL outline_sections:OUTLINE_SECTIONS_SQL "
    "first_client:FIRST_CLIENT_SQL mentioned_parts:MENTIONED_PARTS_SQL new_customers:NEW_CUSTOMERS_SQL membership:MEMBERSHIP_SQL "
    "workbook_diff:WORKBOOK_DIFF_SQL diff_rollup:DIFF_ROLLUP_SQL filtered_documents:FILTERED_DOCUMENTS_SQL clean_documents:CLEAN_DOCUMENTS_SQL "
    "repaired_json:REPAIRED_JSON_SQL typed_answers:TYPED_ANSWERS_SQL sql_functions:SQL_FUNCTIONS_SQL"
)
QUERIES = {n: globals()[n] for n in (x.split(":")[0] for x in _NAMES.split())}
ORACLES = {n: globals()[s] for n, s in (x.split(":") for x in _NAMES.split())}
