"""Joins of the reference jobs: keyed, existence and text-containment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import let, unfold
from ..session import broadcast_if_small, by_rows, cut_lineage

# Fixed value: the item type used when no type name contains the issue text.
UNKNOWN_ITEM_TYPE = 21
_GRAM = 3


def _grams(col, n):
    """All substrings of ``n`` characters; the whole text when it is shorter."""
    start = F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1)))
    return F.transform(start, lambda i: F.substring(col, i, n))


def gram_candidates(low: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_tid, _kid, _key) of texts (_tid, _text) and keys (_kid, _key), both in lower case, that share the key's rarest gram.

    A key has the grams of three characters in it, a shorter one itself. A text is posted
    under those of its grams that any key has; a key is filed under the one that the
    fewest texts have, so keys that begin alike, or hold common grams, don't meet all
    texts. A key with a gram that no text has is in none.
    """
    sizes = sorted(r["n"] for r in wanted.select(F.least(F.length("_key"), F.lit(_GRAM)).alias("n")).distinct().collect())  # three at most
    if not sizes:
        return low.join(wanted, F.col("_text") == F.col("_key")).select("_tid", "_kid", "_key")  # no keys, no pairs
    key_grams = unfold(wanted, ["_kid", "_key"], F.array_distinct(_grams(F.col("_key"), F.least(F.length("_key"), F.lit(_GRAM)))), "_gram")
    text_grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_text"), F.lit(n)) for n in sizes])))
    postings = cut_lineage(unfold(low, ["_tid"], text_grams, "_gram").join(key_grams.select("_gram").distinct(), "_gram", "left_semi"))
    frequency = postings.groupBy("_gram").agg(F.count("*").alias("_texts"))
    known = key_grams.join(frequency, "_gram", "left").na.fill(0, ["_texts"])
    rarest = known.groupBy("_kid").agg(F.min(F.struct("_texts", "_gram")).alias("_r"), F.first("_key").alias("_key"))
    filed = rarest.where(F.col("_r._texts") > 0).select("_kid", "_key", F.col("_r._gram").alias("_gram"))
    return postings.join(filed, "_gram").select("_tid", "_kid", "_key")


def contained_pairs(texts: DataFrame, text_id: str, text: str, keys: DataFrame, key_id: str, key: str) -> DataFrame:
    """(text id, key id) wherever the key occurs in the text, ignoring case.

    Candidates come from an index of grams (:func:`gram_candidates`), hits are then verified.
    Works at any size of both sides. Blank keys match nothing. Both ids are unique.
    """
    low = texts.select(F.col(text_id).alias("_tid"), F.lower(text).alias("_text"))
    wanted = keys.where(F.col(key) != "").select(F.col(key_id).alias("_kid"), F.lower(key).alias("_key"))
    # Candidates carry ids only; each text joins back once for the check.
    hits = gram_candidates(low, wanted).join(low, "_tid").where(F.contains("_text", "_key"))
    return hits.select(F.col("_tid").alias(text_id), F.col("_kid").alias(key_id))


def first_keyword_match(events: DataFrame, event_id: str, title: str, clients: DataFrame, out: str = "client", max_bytes: int = 4 << 20) -> DataFrame:
    """First client in list order whose keyword is in the title, ignoring case; else blank.

    ``clients`` has the columns client, keyword, position; equal positions go by
    keyword, then client. The list travels as one sorted array with every task; one of more than
    ``max_bytes`` is an error, to be matched by :func:`contained_pairs`. Events are
    not shuffled and their ids may repeat.
    """
    usable = clients.where(F.coalesce(F.col("keyword"), F.lit("")) != "")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("keyword") + F.octet_length(F.col("client").cast("string"))), F.lit(0)).alias("n")).first()["n"]
    if size > max_bytes:
        raise ValueError(f"a client list of {size} bytes; at most {max_bytes} can travel with every task")
    listed = usable.agg(
        F.array_sort(F.collect_list(F.struct("position", F.lower("keyword").alias("keyword"), "client"))).alias("l")
    ).scalar()
    hits = let(F.lower(title), lambda low: F.filter(F.col("_clients"), lambda c: F.contains(low, c["keyword"])))
    hit = F.get(hits, F.lit(0))["client"]
    return events.withColumn("_clients", listed).withColumn(out, F.coalesce(hit, F.lit(""))).drop("_clients")


def type_lookup(items: DataFrame, issue: str, types: DataFrame, out: str = "type_id") -> DataFrame:
    """Highest id of the types whose name contains the issue text, ignoring case; else 21.

    ``types`` has type_id and type_name. A blank issue is contained in every name, a null one
    in none. Distinct issues meet distinct names once, by :func:`contained_pairs`;
    items join the result from the left, which Spark can split for a hot issue.
    """
    names = types.where(F.col("type_name").isNotNull()).groupBy(F.lower("type_name").alias("_name")).agg(F.max("type_id").alias("_best"))
    issues = items.select(F.lower(issue).alias("_issue")).distinct()
    pairs = contained_pairs(names, "_name", "_name", issues, "_issue", "_issue")
    found = pairs.join(names, "_name").groupBy("_issue").agg(F.max("_best").alias("_best"))
    any_name = names.agg(F.max("_best").alias("b")).scalar()
    joined = items.withColumn("_issue", F.lower(issue)).join(found, "_issue", "left")
    best = F.coalesce(F.when(F.col("_issue") == "", any_name).otherwise(F.col("_best")), F.lit(UNKNOWN_ITEM_TYPE))
    return joined.withColumn(out, best.cast("int")).select(*items.columns, out)


def mention_join(sections: DataFrame, section_id: str, listed: str, characters: DataFrame, name: str) -> DataFrame:
    """(section id, character name): the character's name contains a listed name, ignoring case.

    ``listed`` is a comma list; blank entries are skipped. The distinct listed
    names meet the distinct characters once. Names are made unique per distinct list, which
    sections then join, so no task holds the sections' rows, however many there are.
    """
    names = F.transform(F.split(listed, ","), lambda n: F.lower(F.trim(n)))
    rows = sections.select(section_id, F.filter(names, lambda n: n != "").alias("_l")).where(F.size("_l") > 0)
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_l"))))
    own = cut_lineage(by_rows(rows, [section_id]).groupBy(section_id).agg(lists.alias("_l")))
    entries = own.select("_l").distinct().select("_l", F.explode("_l").alias("_n"))
    people = characters.select(F.col(name).alias("_c")).where(F.col("_c") != "").distinct()
    pairs = contained_pairs(people, "_c", "_c", entries.select("_n").distinct(), "_n", "_n")
    named = cut_lineage(entries.join(pairs, "_n").select("_l", F.col("_c").alias(name)).distinct())
    return own.join(broadcast_if_small(named), "_l").select(section_id, name)


def not_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner (set difference on the keys)."""
    return left.join(right.select(*keys), keys, "left_anti")


def known_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` that have a partner."""
    return left.join(right.select(*keys), keys, "left_semi")


def frontier(*link_sets: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Distinct urls of several link sets, without those already visited."""
    merged = link_sets[0]
    for other in link_sets[1:]:
        merged = merged.unionByName(other)
    merged = merged.distinct()
    return merged if visited is None else not_in(merged, visited, merged.columns)


def left_join_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose right side may have a hot key.

    Spark cannot split the right side of a left outer join. So partners come from an
    inner join, which it can split on both sides, and rows without partner from an
    anti-join.
    """
    matched = left.join(right, keys)
    alone = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def crawl_items(crawls: DataFrame, pages: DataFrame, items: DataFrame, types: DataFrame) -> DataFrame:
    """crawl -> page -> item -> type, keeping crawls and pages that have no item."""
    typed = items.join(broadcast_if_small(types), "type_id", "left")
    return left_join_hot(crawls, left_join_hot(pages, typed, ["page_id"]), ["crawl_id"])


def one_crawl(websites: DataFrame, crawls: DataFrame, crawl_id: int) -> DataFrame:
    """Inner join with an extra predicate on the right side (pushed to its scan)."""
    return websites.join(crawls, (websites["website"] == crawls["website"]) & (crawls["crawl_id"] == crawl_id)).drop(
        crawls["website"]
    )


def membership_fanout(spaces: DataFrame, members: DataFrame, users: DataFrame, since) -> DataFrame:
    """(space, user, e-mail) of active spaces, human members and valid addresses."""
    from ..functions.text import valid_email
    from ..functions.values import first_text, resource_id

    active = spaces.where(F.col("last_active") >= since).select(
        resource_id(F.col("name")).alias("space_id"), first_text(F.col("display_name"), F.lit("Unnamed Space")).alias("space_name")
    )
    people = members.where(F.col("member_type") == "HUMAN").select(
        resource_id(F.col("space")).alias("space_id"), resource_id(F.col("member")).alias("user_id")
    )
    reachable = users.where(valid_email(F.col("email"))).select("user_id", "email")
    return active.join(people, "space_id").join(reachable, "user_id").select("space_id", "space_name", "user_id", "email")
