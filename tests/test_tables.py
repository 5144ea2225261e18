"""Header, sync, reshape, ordering, matching and diff operators on literal tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridweave.operators import headers as H
from gridweave.operators import matching as J
from gridweave.operators import ordering as O
from gridweave.operators import reshape as R
from gridweave.operators import sections as C
from gridweave.operators import sync as S
from gridweave.operators.diff import check_config, discrepancy_rollup, table_diff


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# ------------------------------------------------------------------ headers


def test_resolve_headers_uses_alias_order(spark):
    df = spark.createDataFrame([(1, "n", "t")], "` NAME ` int, Task_Title string, `Owner` string")
    got = H.resolve_headers(df, H.TASK_ALIASES)
    assert got.columns == ["title", "assignedTo"] and got.first()["title"] == "n"


def test_select_by_name(spark):
    df = spark.createDataFrame([("a", 600, "x"), ("b", 400, "[dept]")], "name string, salary int, dept string")
    got = H.select_by_name(df, "Select [name], [dept]  where [salary] > 500 or [dept] = '[dept]' ")
    assert rows(got) == [("a", "x"), ("b", "[dept]")]
    with pytest.raises(ValueError, match="nope"):
        H.select_by_name(df, "Select [nope]")
    assert rows(H.select_by_name(df, "select [name]")) == [("a",), ("b",)]


def test_update_evolve_require(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    up = spark.createDataFrame([(2, "new", "?")], "id int, y string, other string")
    got, applied = H.update_by_header(df, "id", up)
    assert rows(got) == [(1, "a", "b"), (2, "c", "new")] and applied == ["y"]
    a, b = H.evolve_schema(df, spark.createDataFrame([("z", 3.5)], "y string, w double"))
    assert a.columns == b.columns == ["id", "x", "y", "w"] and a.schema == b.schema or a.dtypes == b.dtypes
    with pytest.raises(ValueError, match="p, q"):
        H.require_columns(df, ["p", "id", "q"])
    with pytest.raises(ValueError, match='"p"'):
        H.require_columns(df, ["p", "q"], first_only=True)


def test_defaults_and_inserts(spark):
    df = spark.createDataFrame([(1, "0", None), (2, "k", "Done")], "n int, id string, status string")
    got = H.with_defaults(df, {"status": "New", "extra": "e"}, "task", "n")
    assert rows(got, "id", "status", "extra") == [("k", "Done", "e"), ("task-1", "New", "e")]
    new = spark.createDataFrame([(1, "t", "Open", "u"), (2, "", "Open", "u")], "row int, Title string, status string, assignedTo string")
    good, bad = H.insert_by_header(["ID", "Title", "Status", "AssignedTo", "Zzz"], new, F.lit("now"), F.lit(1000), "row")
    assert rows(good) == [("TASK-1001", "t", "Open", "u", "")] and rows(bad, "row") == [(2,)]


# ------------------------------------------------------------------ upsert and sync


def test_upsert_on_empty_target(spark):
    target = spark.createDataFrame([], "uniqueIndicator string")
    up = spark.createDataFrame(
        [(1, "2025-02-11-100.5--2025-01-01", "2025-02-11", "-100.50", "2025-01-01", "x"), (2, "2025-03-01-0--", "2025-03-01", None, None, None)],
        "n int, uniqueIndicator string, Date string, Amount string, `Create Date` string, `Some Extra` string",
    )
    got = S.upsert(target, up, ["uniqueIndicator"], "n")
    assert got.columns == ["uniqueIndicator", "Date", "Amount", "Create Date", "Some Extra", "_action"]
    assert [r["_action"] for r in got.collect()] == ["inserted", "inserted"]


def test_upsert_rules(spark):
    target = spark.createDataFrame([("a", 1, "keep", 1), ("a", 1, "keep", 2), ("b", 2, "k", 3), (None, 9, "n", 4), ("", 8, "m", 5)], "k string, v int, c string, pos int")
    up = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 2, 3), ("", 0, 4), (None, 0, 5), ("z", 7, 6)], "k string, v int, n int")
    got = S.upsert(target, up, ["k"], "n", target_order="pos")
    want = {("a", 1, "keep", 1, "kept"), ("a", 6, "keep", 2, "updated"), ("b", 2, "k", 3, "unchanged"), (None, 9, "n", 4, "kept"), ("", 8, "m", 5, "kept"), ("z", 7, None, None, "inserted")}
    assert {tuple(r) for r in got.collect()} == want
    again = S.upsert(got.drop("_action"), up, ["k"], "n", target_order="pos")
    assert {r["_action"] for r in again.collect()} <= {"kept", "unchanged"}
    assert {tuple(r) for r in again.drop("_action").collect()} == {w[:-1] for w in want}
    assert rows(S.action_counts(got)) == [("inserted", 1), ("kept", 3), ("unchanged", 1), ("updated", 1)]


def test_get_or_create_and_absent(spark):
    dim = spark.createDataFrame([(3, "seo"), (7, "web")], "id int, kw string")
    names = spark.createDataFrame([(1, " Web "), (2, "new"), (3, "NEW"), (4, "other"), (5, None)], "n int, kw string")
    grown, got = S.get_or_create_key(dim, names, "kw", "id", "n")
    assert rows(grown) == [(3, "seo"), (7, "web"), (8, "new"), (9, "other")]
    assert {(r["n"], r["id"]) for r in got.collect()} == {(1, 7), (2, 8), (3, 8), (4, 9), (5, None)}
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a int, b int")
    assert rows(S.insert_if_absent(spark.createDataFrame([(1, 1)], "a int, b int"), pairs, ["a", "b"])) == [(1, 2)]


def test_replace_window_keeps_others(spark):
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    mk = lambda data: spark.createDataFrame(data, "id string, owner string, s string, e string").select(
        "id", "owner", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    target = mk([("old", "me", "2024-01-01", "2024-01-02"), ("in", "me", "2024-01-05", "2024-01-06"), ("far", "me", "2024-03-01", "2024-03-02"), ("x", "you", "2024-01-05", "2024-01-06"), ("null", "me", None, None)])
    fresh = mk([("in", "me", "2024-01-05", "2024-01-06"), ("in", "me", "2024-01-05", "2024-01-06"), ("late", "me", "2024-01-18", "2024-01-19"), ("run", "me", "2024-01-02", "2024-01-04"), ("y", "you", "2024-01-05", "2024-01-06")])
    got = S.replace_window(target, fresh, F.lit("me"), now, "s", "e", "owner", "id", back_days=-1)
    assert sorted(r["id"] for r in got.collect()) == ["in", "null", "old", "run", "x"]


def test_touch_last_sync(spark):
    t0, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    control = spark.createDataFrame([("a", t0, 0), ("b", t0, 2)], "owner string, stamp timestamp_ntz, slot int")
    owners = spark.createDataFrame([(x,) for x in "bcdefg"], "owner string")
    got = S.touch_last_sync(control, owners, F.lit("2024-02-01").cast("timestamp_ntz"), "owner", "stamp", "slot")
    assert rows(got) == [("a", t0, 0), ("b", now, 2), ("c", now, 1), ("d", now, 3), ("e", now, 4)]


def test_ingest_is_idempotent(spark):
    t0 = datetime(2024, 1, 1)
    old = spark.createDataFrame([("m1", "x", t0)], "id string, text string, touched timestamp_ntz")
    batch = spark.createDataFrame([("m1", "changed", 1), ("m2", "first", 2), ("m2", "second", 3)], "id string, text string, n int")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    once = S.ingest_new_messages(old, batch, "id", "touched", now, "n")
    assert rows(once, "id", "text") == [("m1", "x"), ("m2", "first")]
    assert rows(S.ingest_new_messages(once, batch, "id", "touched", now, "n")) == rows(once)


def test_mailbox_and_status(spark):
    box = spark.createDataFrame([(i, "INBOX", False, datetime(2024, 1, i)) for i in range(1, 8)], "id int, folder string, seen boolean, ts timestamp_ntz")
    got = S.move_matching(box, "INBOX", 2, ["ts", "id"], before=F.lit("2024-01-05").cast("timestamp_ntz"), dest="Done")
    assert [(r["id"], r["folder"], r["seen"]) for r in got.where("moved").orderBy("id").collect()] == [(1, "Done", True), (2, "Done", True)]
    assert got.count() == 7
    changes = spark.createDataFrame([(1, "Archive"), (99, "x")], "id int, v string")
    updated, unmatched = S.update_status(box, changes, "id", "folder", "v")
    assert rows(updated.where("folder = 'Archive'"), "id") == [(1,)] and rows(unmatched) == [(99,)]
    with pytest.raises(ValueError):
        S.require_matched(unmatched)
    cfg = spark.createDataFrame([("a", "N", "N"), ("b", "Y", "Y")], "book string, compare string, main string")
    edits = spark.createDataFrame([("a", "Y", "N"), ("zz", "Y", "Y")], "book string, compare string, main string")
    assert rows(S.merge_config(cfg, edits, "book", ["compare", "main"])) == [("a", "Y", "N"), ("b", "Y", "Y")]


# ------------------------------------------------------------------ reshape


def test_expand_links_golden(spark):
    df = spark.createDataFrame([("123", ["456", "789"]), ("124", ["567"]), ("125", [])], "parentId string, linkedRecords array<string>")
    got = R.expand_links(df)
    assert got.columns == ["parentIdlinkedRecordsId", "parentId", "linkedRecordId"]
    assert rows(got) == [("123.456", "123", "456"), ("123.789", "123", "789"), ("124.567", "124", "567")]
    with pytest.raises(ValueError):
        R.expand_links(df.select("parentId"))


def test_flatten_report_needs_titles(spark):
    text = '{"Columns":{"Column":[{"ColTitle":"Date"},{"ColTitle":"Amount"}]},"Rows":{"Row":[{"type":"Data","ColData":[{"value":"d"}]}]}}'
    df = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", R.REPORT_SCHEMA).alias("report"))
    with pytest.raises(Exception, match="Split"):
        R.flatten_report(df, "report", R.REPORT_TITLES).collect()
    with pytest.raises(ValueError, match="Create Date"):
        R.flatten_report(df, "report", ["Date", "Amount", "Split"])


def test_flatten_report_is_compiled(spark):
    """Odd reports by plain columns and explodes; no function over arrays is interpreted for each report."""
    head = '"Columns":{"Column":[{"ColTitle":"Split"},{},{"ColTitle":"Date"},null,{"ColTitle":"Amount"},{"ColTitle":"Create Date"}]}'
    data = '{"type":"Data","ColData":[{"value":"s"},{"value":"x"},{"value":"d"},null,{"value":"-007.50"}]}'
    odd = '{"type":"Data"},{"ColData":[]},null,{"type":"Section","Rows":{"Row":null}},{"type":"Section"}'
    nested = '{"type":"Section","Rows":{"Row":[' + data + ',null,{"type":"Note"},{"type":"Section","ColData":[]}]}}'
    texts = [f'{{{head},"Rows":{{"Row":[{data},{odd},{nested}]}}}}', f"{{{head}}}", f'{{"Rows":{{"Row":[{data}]}}}}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.from_json("t", R.REPORT_SCHEMA).alias("report"))
    flat = R.flatten_report(df, "report", [*R.REPORT_TITLES, ""], ["n"])
    full, blank = ("d-7.5-s-", "d", "-007.50", "s", "", "x"), ("-0--", "", "", "", "", "")
    assert rows(flat) == sorted([(0, *full), (0, *full), (0, *blank), (2, *blank)])
    plan = R.flatten_report(df, "report", R.REPORT_TITLES, ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    for rest in ("", ',"Rows":{"Row":[]}', ',"Rows":{"Row":[{"type":"Section"}]}'):
        short = spark.createDataFrame([('{"Columns":{"Column":[{"ColTitle":"Date"}]}' + rest + "}",)], "t string").select(F.from_json("t", R.REPORT_SCHEMA).alias("report"))
        with pytest.raises(Exception, match="Amount"):
            R.flatten_report(short, "report", R.REPORT_TITLES).collect()


def test_merge_and_payload(spark):
    df = spark.createDataFrame([(7, "Ann", None)], "InvoiceNumber int, name string, x string")
    assert df.select(R.mail_merge(df, "{{name}}/{{x}}/{{?}}", df.columns).alias("b")).first()["b"] == "Ann//{{?}}"
    assert df.select(R.row_payload(df.columns).alias("p")).first()["p"] == '{"InvoiceNumber":7,"name":"Ann","x":null}'


def test_characters(spark):
    df = spark.createDataFrame([('{"characters":[{"name":"A","role":"r"},{"name":"B"}]}',)], "j string")
    assert rows(R.character_rows(df, "j", []), "position", "name", "role") == [(1, "A", "r"), (2, "B", None)]


# ------------------------------------------------------------------ ordering


def test_number_rows_with_hot_group(spark):
    rnd = random.Random(1)
    data = [("hot", i, rnd.randint(0, 9)) for i in range(400)] + [(f"g{i % 7}", i, 1) for i in range(300)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g string, o int, v int")
    got = O.number_rows(df, ["o"], ["g"], {"run": "v"}, "n", "size", pieces=8).collect()
    by = {}
    for g, o, v in sorted(data):
        by.setdefault(g, []).append((o, v))
    for r in got:
        group = by[r["g"]]
        pos = [o for o, _ in group].index(r["o"])
        assert r["n"] == pos + 1 and r["size"] == len(group) and r["run"] == sum(v for _, v in group[: pos + 1])


def test_heavy_leading_value_is_split(spark):
    data = [(1, i) for i in range(500)] + [(2 + i % 50, i) for i in range(500)] + [(None, i) for i in range(10)]
    df = spark.createDataFrame(data, "a int, b int")
    sized = O.with_pieces(df, ["a", "b"], 8).groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert sized < 300
    got = O.number_rows(df, ["a", "b"], pieces=8).orderBy("row_no").collect()
    want = sorted(data, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    assert [(r["a"], r["b"]) for r in got] == want
    assert [r["row_no"] for r in got] == list(range(1, len(data) + 1))


def test_previous_rows_and_parts(spark):
    data = [("c", 1, "x"), ("c", 2, ""), ("c", 3, "y"), ("c", 4, None), ("c", 5, "z"), ("d", 1, "q")]
    df = O.number_rows(spark.createDataFrame(data, "ch string, s int, t string"), ["s"], ["ch"], group_rows="group_rows")
    got = {(r["ch"], r["s"]): r["prev"] for r in O.previous_rows(df, ["ch"], "t", 2, "|", "prev").collect()}
    assert got == {("c", 1): None, ("c", 2): "x", ("c", 3): "x", ("c", 4): "x|y", ("c", 5): "x|y", ("d", 1): None}
    parts = O.ordered_text(df, ["ch"], F.coalesce("t", F.lit("")), "+", rows_per_part=2)
    assert rows(parts, "ch", "part_no", "text") == [("c", 0, "x+"), ("c", 1, "y+"), ("c", 2, "z"), ("d", 0, "q")]
    last = df.where(O.is_last_in_group())
    assert rows(last, "ch", "s") == [("c", 5), ("d", 1)]


def test_previous_by_value_leaves_gaps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "n int, s string")
    got = {r["n"]: r["p"] for r in O.previous_by_value(df, "n", "s", 2, "p").collect()}
    assert got == {1: None, 2: "Chapter 1: a", 4: "Chapter 2: b"}


def test_target_words(value):
    t = lambda n, s: C.target_words(F.lit(2000), n, s, F.lit(True))
    assert [value(t, 3, s, types=["int", "int"]) for s in (1, 2, 3)] == [878, 799, 719]
    imp = lambda c: C.important_chapter(c, F.lit(20), F.lit(None).cast("string"))
    assert [c for c in range(1, 21) if value(imp, c, types=["int"])] == [1, 5, 6, 10, 11, 15, 16, 20]


# ------------------------------------------------------------------ matching and diff


def test_contained_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("abAB ") for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    keys = [(i, "".join(rnd.choice("abAB") for _ in range(rnd.randint(0, 5)))) for i in range(40)]
    got = J.contained_pairs(spark.createDataFrame(texts, "t int, x string"), "t", "x", spark.createDataFrame(keys, "k int, y string"), "k", "y")
    want = {(t, k) for t, x in texts for k, y in keys if y and y.lower() in x.lower()}
    assert {tuple(r) for r in got.collect()} == want


def test_keys_that_begin_alike_have_few_candidates(spark):
    """1,500 keys with one beginning over 1,500 texts that all hold it: the rarest gram decides, not the first."""
    low = spark.range(1500).select(F.col("id").alias("_tid"), F.concat(F.lit("common start "), F.lpad(F.conv(F.col("id") * 7919, 10, 36), 6, "x"), F.lit(" end")).alias("_text"))
    low = low.withColumn("_text", F.lower("_text"))
    wanted = low.select(F.col("_tid").alias("_kid"), F.expr("substring(_text, 1, 19)").alias("_key"))
    assert J.gram_candidates(low, wanted).count() < 10_000
    found = J.contained_pairs(low, "_tid", "_text", wanted, "_kid", "_key")
    assert found.count() == 1500 and found.where("_tid <> _kid").count() == 0
    assert J.contained_pairs(low, "_tid", "_text", wanted.where("_key = ''"), "_kid", "_key").count() == 0


def test_long_client_list_is_refused(spark):
    events = spark.createDataFrame([(1, "a")], "id int, title string")
    clients = spark.createDataFrame([("c", "k" * 50, 1)], "client string, keyword string, position int")
    with pytest.raises(ValueError):
        J.first_keyword_match(events, "id", F.col("title"), clients, max_bytes=20)


def test_replace_windows(spark):
    """Each owner by its own days; null and low days are 7; owners without a row, null owners and repeated control rows."""
    d = lambda n: datetime(2024, 1, 20) + timedelta(days=n)
    old = [(i, o, d(n), d(n + 1)) for i, (o, n) in enumerate([(1, -9), (1, -3), (1, 50), (2, -3), (2, -1), (3, -3), (None, 0), (4, -8), (4, -6)])]
    new = [(100 + i, o, d(n), d(n + 0.5)) for i, (o, n) in enumerate([(1, -7.2), (1, -8), (1, 6), (1, 8), (2, -3), (2, 1.5), (2, 4), (3, 0), (None, 0)])] + [(102, 1, d(6), d(6.5))]
    kinds = "id int, owner int, s timestamp_ntz, e timestamp_ntz"
    control = spark.createDataFrame([(1, 0, None), (2, 1, 2), (2, 2, 1), (4, -1, 3), (None, 1, 1)], "owner int, back_days int, forward_days int")
    got = S.replace_windows(spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds), control, F.lit(d(0)).cast("timestamp_ntz"), "s", "e", "owner", "id")
    assert sorted(r["id"] for r in got.collect()) == [0, 3, 5, 6, 7, 100, 102, 105]


def test_first_keyword(spark):
    events = spark.createDataFrame([(1, "Call with ACME about beta"), (2, "beta"), (3, "none")], "id int, title string")
    clients = spark.createDataFrame([("B", "Beta", 2), ("A", "acme", 1), ("N", "", 0)], "client string, keyword string, position int")
    want = [(1, "A"), (2, "B"), (3, "")]
    run = lambda: rows(J.first_keyword_match(events, "id", F.col("title"), clients), "id", "client")
    assert run() == want


def test_hot_left_join_and_fanout(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, v string")
    assert {tuple(r) for r in J.left_join_hot(left, right, ["k"]).collect()} == {(1, "a"), (1, "b"), (2, None)}
    web = spark.createDataFrame([("a",), ("b",)], "website string")
    crawls = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "website string, crawl_id int")
    assert rows(J.one_crawl(web, crawls, 2)) == [("a", 2)]


def books(spark):
    config = spark.createDataFrame([("m", "Y", "Y"), ("o", "Y", "N"), ("off", "N", "N")], "book string, compare string, main string")
    tables = spark.createDataFrame([("m", "T"), ("m", "gone"), ("o", "T"), ("o", "more"), ("off", "T")], "book string, tab string")
    headers = spark.createDataFrame([("m", "T", 0, "a"), ("m", "T", 1, "b"), ("o", "T", 0, "a"), ("o", "T", 1, "B"), ("o", "T", 2, "")], "book string, tab string, col_idx int, header string")
    cells = spark.createDataFrame(
        [("m", "T", 1, 0, "=A"), ("o", "T", 1, 0, "=A"), ("m", "T", 2, 0, "=X"), ("o", "T", 2, 0, "plain"), ("m", "T", 6, 0, "=late"), ("o", "T", 3, 2, "=new"), ("m", "T", 4, 1, "v")],
        "book string, tab string, row_no int, col_idx int, cell string",
    )
    return tables, headers, cells, config


def test_table_diff(spark):
    got = {(r["tab"], r["type"], r["column_letter"]): r for r in table_diff(*books(spark)).collect()}
    assert set(got) == {("gone", "missingTab", None), ("more", "extraTab", None), ("T", "columnGroup", "A"), ("T", "columnGroup", "B"), ("T", "columnGroup", "C")}
    assert [tuple(c) for c in got["T", "columnGroup", "A"]["formula_mismatches"]] == [(3, "=X", "(no formula)")]
    assert (got["T", "columnGroup", "B"]["main_header"], got["T", "columnGroup", "B"]["other_header"]) == ("b", "B")
    assert [tuple(c) for c in got["T", "columnGroup", "C"]["formula_mismatches"]] == [(4, "(no formula)", "=new")]
    total = discrepancy_rollup(table_diff(*books(spark))).where("level = 3").first()
    assert (total["book"], total["discrepancies"], total["issues"]) == ("o", 5, 5)


@pytest.mark.parametrize("bad", [[("a", "Y", "N")], [("a", "Y", "Y"), ("b", "Y", "Y")], [("a", "N", "Y"), ("b", "Y", "N")], [("a", "Y", "Y"), ("b", "N", "N")]])
def test_diff_config(spark, bad):
    with pytest.raises(ValueError):
        check_config(spark.createDataFrame(bad, "book string, compare string, main string"))


def test_get_or_create_ignores_case_of_the_dimension(spark):
    dim = spark.createDataFrame([(1, "News.Org"), (4, " news.org")], "id int, kw string")
    names = spark.createDataFrame([("news.org", 1), ("NEW", 2)], "kw string, n int")
    grown, got = S.get_or_create_key(dim, names, "kw", "id", "n")
    assert {(r["kw"], r["id"]) for r in got.collect()} == {("news.org", 1), ("NEW", 5)} and grown.count() == 3
