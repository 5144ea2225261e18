"""Fuzzy duplicate search: block, compare, group, report.

Equal records are folded into one profile with a copy count first, so a block of
copies costs one row; group sizes, edge counts and averages are computed from the
counts. Profiles of a block are dealt to tiles, and a task compares all profiles of two
tiles at once. In a large block a profile is filed under its rarest characters only, as
many as are needed so that any partner above the threshold must share one of them, where
that makes fewer pairs than the whole block. Both find exactly the same pairs.

Joins of written steps ask for a sort-merge join: Spark sizes such a table by its
compressed file, and columns that repeat would be sent to the driver many times as large.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import weighted_ratios
from ..functions.values import let, unfold
from ..session import cut_lineage
from .ordering import number_rows

# Compared columns with their weights, and the threshold.
CONTACT_WEIGHTS = {"First Name": 0.2, "Last Name": 0.2, "Email": 0.35, "Phone Number": 0.25}
THRESHOLD = 0.7
_SLACK = 1e-9
#: Profiles of a tile, of a block that gets the character filter, and pairs of a task, about.
TILE, WIDE, TASK_PAIRS = 512, 1 << 14, 1 << 23


def preprocess(col: Column, null_is_match: bool = True) -> Column:
    """Lower-case trimmed text; a missing value becomes ``nan`` (or stays missing)."""
    text = F.regexp_replace(F.lower(col.cast("string")), r"^\s+|\s+$", "")
    return F.coalesce(text, F.lit("nan")) if null_is_match else text


def block_key(cols: list[Column]) -> Column:
    """First two characters of every column, joined without separator."""
    return F.concat(*[F.substring(F.coalesce(c, F.lit("nan")), 1, 2) for c in cols])


def build_profiles(df: DataFrame, idx: str, columns: list[str], null_is_match: bool = True) -> DataFrame:
    """One row per distinct compared tuple: rep (lowest idx), copies, block, p0..pk."""
    ps = [f"p{i}" for i in range(len(columns))]
    texts = df.select(F.col(idx).alias("_idx"), *[preprocess(F.col(f"`{c}`"), null_is_match).alias(p) for c, p in zip(columns, ps)])
    folded = texts.groupBy(*ps).agg(F.min("_idx").alias("rep"), F.count("*").alias("copies"))
    return folded.withColumn("block", block_key([F.col(p) for p in ps]))


def _tokens(p: str, i: int) -> Column:
    """Characters of a text as (column, hash of character and its occurrence number)."""
    chars = F.array_distinct(F.regexp_extract_all(F.col(p), F.lit("(?s)."), F.lit(0)))

    def occurrences(ch: Column) -> Column:
        times = F.length(F.col(p)) - F.length(F.replace(F.col(p), ch, F.lit("")))
        return F.transform(F.sequence(F.lit(1), times), lambda o: F.struct(F.lit(i).alias("c"), F.xxhash64(F.lit(i), ch, o).alias("h")))

    blank = F.array(F.struct(F.lit(i).alias("c"), F.xxhash64(F.lit(i), F.lit(""), F.lit(1)).alias("h")))
    none = F.array().cast("array<struct<c:int,h:bigint>>")
    return F.when(F.col(p).isNull(), none).when(F.col(p) == "", blank).otherwise(F.flatten(F.transform(chars, occurrences)))


def with_prefixes(profiles: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """Add ``prefix``: the rare characters under which a profile must be filed.

    Characters are ordered by how many profiles of the block have them. The common
    end of that order is left out for as long as the characters in it alone could
    not lift any pair above the threshold: with k of a column's n characters left
    out, that column adds at most weight * 2k / (n + k).
    """
    ps = [f"p{i}" for i in range(len(weights))]
    tokens = F.concat(*[_tokens(p, i) for i, p in enumerate(ps)])
    filed = unfold(profiles, ["rep", "block"], tokens, "_t").select("rep", "block", "_t.c", "_t.h")
    common = filed.groupBy("block", "h").agg(F.count("*").alias("df"))
    # One row per profile; the list is as long as its own text.
    ranked = (
        filed.join(common.hint("merge"), ["block", "h"])
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h", "c")), asc=False).alias("_r"))
    )
    sized = profiles.join(ranked.hint("merge"), "rep").withColumn(
        "_len", F.array(*[F.greatest(F.coalesce(F.length(p), F.lit(1)), F.lit(1)) for p in ps])
    )
    counts = F.array(*[F.lit(0) for _ in ps])
    start = F.struct(counts.alias("k"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def bounded(k: Column) -> Column:
        bound = F.lit(0.0)
        for i, w in enumerate(weights):
            bound = bound + F.lit(2.0 * w) * k[i] / (F.col("_len")[i] + k[i])
        return F.struct(k.alias("k"), (bound <= threshold - _SLACK).alias("ok"))

    def leave_out(state: Column, token: Column) -> Column:
        more = F.transform(state["k"], lambda x, i: x + F.when(i == token["c"], 1).otherwise(0))
        tried = let(
            let(more, bounded),
            lambda t: F.struct(t["k"].alias("k"), (state["n"] + F.when(t["ok"], 1).otherwise(0)).alias("n"), t["ok"].alias("open")),
        )
        return F.when(state["open"], tried).otherwise(state)

    left_out = F.aggregate("_r", start, leave_out)["n"]
    kept = F.slice("_r", left_out + 1, F.greatest(F.size("_r") - left_out, F.lit(0)))
    shared = F.transform(F.filter(kept, lambda t: t["df"] > 1), lambda t: t["h"])
    return sized.withColumn("prefix", shared).drop("_r", "_len")


def _cells(profiles: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """Profiles by the cell in which they meet: a block (``h`` 0), or a character ``h`` of a wide one; ``n`` is its size."""
    sizes = profiles.groupBy("block").agg(F.count("*").alias("n"))
    placed = profiles.where(F.col("rep").isNotNull()).join(sizes.hint("merge"), "block").where("n > 1")
    cols = ["block", "h", "n", "prefix", *profiles.drop("block").columns]
    whole = lambda df: df.withColumn("h", F.lit(0).cast("bigint")).withColumn("prefix", F.array().cast("array<bigint>")).select(*cols)
    if (sizes.agg(F.max("n")).first()[0] or 0) <= WIDE:
        return whole(placed)
    filed = cut_lineage(with_prefixes(placed.where(F.col("n") > WIDE), weights, threshold).withColumn("prefix", F.array_distinct("prefix")))
    met = filed.select("block", F.explode("prefix").alias("h")).groupBy("block", "h").agg(F.count("*").alias("met")).where("met > 1")
    work = met.groupBy("block").agg(F.sum(F.col("met").cast("double") * F.col("met")).alias("work"))
    judged = filed.join(work.hint("merge"), "block", "left").withColumn("few", F.coalesce("work", F.lit(0.0)) < F.col("n").cast("double") * F.col("n"))
    by_character = judged.where("few").withColumn("h", F.explode("prefix")).join(met.hint("merge"), ["block", "h"]).withColumn("n", F.col("met"))
    return whole(placed.where(F.col("n") <= WIDE)).unionByName(whole(judged.where("NOT few"))).unionByName(by_character.select(*cols))


def _tiles(profiles: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """A group of rows for each two tiles ``i`` and ``j`` of a cell, and for each tile alone: their profiles, ``c`` being the tile of each."""
    cells = _cells(profiles, weights, threshold)
    ps = [f"p{i}" for i in range(len(weights))]
    pairs = cells.groupBy("block", "h").agg((F.first("n").cast("double") * F.first("n") / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
    tasks = max(profiles.sparkSession.sparkContext.defaultParallelism, min(int(pairs / TASK_PAIRS), 100_000))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = cells.withColumn("c", F.pmod(F.xxhash64("rep", *ps), tiles).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    met = dealt.select("block", "h", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "prefix", "rep", "copies", *ps)
    return met.repartition(tasks, "block", "h", "i", "j")


def _elsewhere(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x * y share a character below that of this cell: they are taken at the smallest only."""
    prefix, out = rows.column("prefix").chunk(0), np.zeros((len(x), len(y)), bool)
    holder, h = pc.list_parent_indices(prefix).to_numpy(), pc.list_flatten(prefix).to_numpy()
    below = h < rows.column("h")[0].as_py()
    holder, h = holder[below], h[below]
    shared, times = np.unique(h, return_counts=True)
    for one in shared[times > 1]:
        has = np.isin(np.arange(rows.num_rows), holder[h == one])
        out |= has[x][:, None] & has[y]
    return out


def _compare(tiles: DataFrame, weights: list[float], threshold: float, schema: str, report: Callable) -> DataFrame:
    """``report(rows, order, x, y, over, similarity)`` of every two tiles.

    ``order`` ranks the reps; ``x`` and ``y`` are places in ``rows``. ``over`` tells which of x * y are
    pairs above the threshold; a pair of one tile is there once, from its smaller rep.
    """

    def check(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        c, i, j = (rows.column(k).to_numpy() for k in "cij")
        x, y = np.flatnonzero(c == i), np.flatnonzero(c == j)
        total, left = np.zeros((len(x), len(y))), sum(weights)
        for k, w in enumerate(weights):
            p = rows.column(f"p{k}").chunk(0)
            total += weighted_ratios(p.take(pa.array(x)), p.take(pa.array(y)), w)
            left -= w
            reach = total / 100 + left > threshold - _SLACK
            some_x, some_y = reach.any(axis=1), reach.any(axis=0)
            if not (some_x.all() and some_y.all()):  # the others have no pair here
                x, y, total = x[some_x], y[some_y], total[np.ix_(some_x, some_y)]
        order = pc.rank(rows.column("rep"), tiebreaker="dense").to_numpy().astype(np.int64)
        over = order[x][:, None] < order[y] if i[0] == j[0] else order[x][:, None] != order[y]
        over &= total / 100 > threshold
        over &= ~_elsewhere(rows, x, y)
        return report(rows, order, x, y, over, total / 100)

    return tiles.groupBy("block", "h", "i", "j").applyInArrow(check, schema)


def _pairs(tiles: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """A row for each pair."""

    def report(rows, order, x, y, over, similarity):
        at = np.nonzero(over)
        a, b = x[at[0]], y[at[1]]
        swap = order[a] > order[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        side = lambda col, of: rows.column(col).take(pa.array(of))
        columns = [side("block", a), side("rep", a), side("rep", b), side("copies", a), side("copies", b), pa.array(similarity[at])]
        return pa.table(columns, names=["block", "rep_a", "rep_b", "copies_a", "copies_b", "similarity"])

    kind, count = (tiles.schema[c].dataType.simpleString() for c in ("rep", "copies"))
    return _compare(tiles, weights, threshold, f"block string, rep_a {kind}, rep_b {kind}, copies_a {count}, copies_b {count}, similarity double", report)


def similar_pairs(profiles: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """Pairs of profiles of one block whose weighted similarity is above the threshold."""
    return _pairs(_tiles(profiles, weights, threshold), weights, threshold)


def _star_labels(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the linked groups for the rows and columns of ``over``; a column without link gets the number of rows."""
    none = len(over)
    label = np.arange(none)
    while True:
        columns = np.where(over, label[:, None], none).min(axis=0, initial=none)
        lower = np.minimum(label, np.where(over, columns, none).min(axis=1, initial=none))
        lower = lower[lower]
        if (lower == label).all():
            return label, columns
        label = lower


def _links(tiles: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """The pairs folded in the tasks that find them: (rep, other, s, n), no row for each pair.

    ``s`` and ``n`` are the sums, over some pairs of ``rep``, of their similarity and number in terms of records; each
    pair counts once. Rows with ``other`` link each profile with the first of its group in a tile.
    """

    def report(rows, order, x, y, over, similarity):
        copies = rows.column("copies").to_numpy().astype(np.float64)
        product = copies[x][:, None] * copies[y] * over
        some = over.any(axis=1)
        label, columns = _star_labels(over)
        linked = columns < len(x)
        node, group = np.concatenate([x[some], y[linked]]), np.concatenate([label[some], columns[linked]])
        by = np.lexsort([order[node], group])
        node, group = node[by], group[by]
        first = node[np.searchsorted(group, group)]
        edge = order[node] != order[first]
        node, first = np.unique(np.stack([node[edge], first[edge]]), axis=1)
        sums, rep = np.flatnonzero(some), rows.column("rep")
        none = np.zeros(len(node))
        other = pa.concat_arrays([pa.nulls(len(sums), pa.int64()), pa.array(first, pa.int64())])
        columns = [
            rep.take(pa.array(np.concatenate([x[sums], node]))), rep.take(other),
            pa.array(np.concatenate([(product * similarity).sum(axis=1)[sums], none])), pa.array(np.concatenate([product.sum(axis=1)[sums], none])),
        ]
        return pa.table(columns, names=["rep", "other", "s", "n"])

    kind = tiles.schema["rep"].dataType.simpleString()
    return _compare(tiles, weights, threshold, f"rep {kind}, other {kind}, s double, n double", report)


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Alternates two steps until nothing changes: hang the larger neighbours of a node
    on its smallest neighbour, then the smaller ones. The number of rounds grows
    with the logarithm of the graph, and a hub node is met through a map-side
    minimum and a left-splittable join, never as one collected list.
    """
    e = cut_lineage(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    )
    for _ in range(max_rounds):
        # Done when every node hangs on exactly one root.
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        unsettled = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")
        if unsettled.limit(1).count() == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


@dataclass
class Duplicates:
    """Result of :func:`find_duplicates`; ``pairs`` are found when they are read."""

    pairs: DataFrame
    members: DataFrame
    groups: DataFrame
    records: DataFrame
    columns: list[str]
    idx: str
    record_id: str | None
    null_is_match: bool

    def record_groups(self) -> DataFrame:
        """Every member record with its group id and the group's average."""
        ps = [f"p{i}" for i in range(len(self.columns))]
        keyed = self.records.withColumn(
            "_key", F.struct(*[preprocess(F.col(f"`{c}`"), self.null_is_match).alias(p) for c, p in zip(self.columns, ps)])
        )
        known = self.members.select(F.struct(*ps).alias("_key"), "component").hint("merge")
        numbered = known.join(self.groups.select("component", "group_id", "average_similarity"), "component").drop("component")
        return keyed.join(numbered.hint("merge"), "_key").drop("_key")

    def details(self) -> DataFrame:
        """Member rows, the group columns first."""
        rid = F.col(f"`{self.record_id}`").cast("string") if self.record_id else F.lit(None).cast("string")
        return self.record_groups().select(
            F.col("group_id").alias("Duplicate_Group_ID"),
            F.col("average_similarity").alias("Similarity_Score"),
            F.coalesce(rid, F.lit("N/A")).alias("Record_ID"),
            *[F.col(f"`{c}`") for c in self.records.columns],
        )

    def summary(self, ids_per_part: int = 10_000) -> DataFrame:
        """One row per group with its distinct record ids as text.

        A group with more ids than fit in one cell gets further rows (``Part`` 1, 2
        ...) that carry the rest of the ids.
        """
        rid = F.col(f"`{self.record_id}`").cast("string") if self.record_id else F.lit(None).cast("string")
        ids = self.record_groups().select("group_id", rid.alias("rid"), F.col(self.idx).alias("_idx"))
        known = ids.where(F.coalesce(F.col("rid"), F.lit("N/A")) != "N/A").groupBy("group_id", "rid").agg(F.min("_idx").alias("_idx"))
        numbered = number_rows(known, ["_idx", "rid"], ["group_id"], row_no="_no")
        parts = (
            numbered.withColumn("Part", ((F.col("_no") - 1) / ids_per_part).cast("bigint"))
            .groupBy("group_id", "Part")
            .agg(F.array_sort(F.collect_list(F.struct("_no", "rid"))).alias("_ids"))
            .select("group_id", "Part", F.array_join(F.transform("_ids", lambda x: x["rid"]), ", ").alias("Record_IDs"))
        )
        return self.groups.join(parts.hint("merge"), "group_id", "left").select(
            F.col("group_id").alias("Duplicate_Group_ID"),
            F.coalesce("Part", F.lit(0)).cast("bigint").alias("Part"),
            F.col("records").alias("Number_of_Records"),
            F.col("average_similarity").alias("Average_Similarity"),
            F.coalesce("Record_IDs", F.lit("")).alias("Record_IDs"),
        )


def find_duplicates(
    df: DataFrame,
    idx: str,
    weights: dict[str, float],
    threshold: float = THRESHOLD,
    record_id: str | None = None,
    null_is_match: bool = True,
) -> Duplicates:
    """Groups of records linked by a weighted similarity above ``threshold``.

    ``idx`` is a unique row number that stands for the input order. Groups are
    numbered by the first row of their block, then by their own first row.
    """
    columns, w = list(weights), list(weights.values())
    ps = [f"p{i}" for i in range(len(columns))]
    profiles = build_profiles(df, idx, columns, null_is_match)
    blocks = profiles.groupBy("block").agg(F.min("rep").alias("block_first"), F.count("*").alias("_profiles"))
    useful = profiles.join(blocks.hint("merge"), "block").where("_profiles > 1 OR copies > 1")
    useful = cut_lineage(useful)
    tiles = _tiles(useful.where("_profiles > 1").drop("block_first", "_profiles"), w, threshold)
    # Most profiles of a block may be alike, so a row for each pair is made only for who reads the pairs.
    pairs = _pairs(tiles, w, threshold)
    links = cut_lineage(_links(tiles, w, threshold))
    components = connected_components(links.where(F.col("other").isNotNull()), "rep", "other")

    # Copies of one profile are alike in every column they have.
    self_score = F.lit(0.0)
    for p, weight in zip(ps, w):
        self_score = self_score + F.when(F.col(p).isNotNull(), 100.0 * weight).otherwise(0.0)
    self_score = self_score / 100
    alike = (F.col("copies") > 1) & (self_score > threshold)
    linked = useful.join(components.hint("merge"), useful["rep"] == components["node"], "left").drop("node")
    members = cut_lineage(
        linked.withColumn("_self", F.when(alike, self_score)).where(F.col("component").isNotNull() | F.col("_self").isNotNull())
        .withColumn("component", F.coalesce("component", "rep"))
    )
    copies = F.col("copies").cast("double")
    within = members.groupBy("component").agg(
        F.min("block_first").alias("block_first"),
        F.min("rep").alias("first"),
        F.sum("copies").alias("records"),
        F.sum(F.coalesce(F.col("_self") * copies * (copies - 1) / 2, F.lit(0.0))).alias("_s1"),
        F.sum(F.when(F.col("_self").isNotNull(), copies * (copies - 1) / 2).otherwise(0.0)).alias("_n1"),
    )
    sums = links.groupBy("rep").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    between = sums.join(components.hint("merge"), sums["rep"] == components["node"]).groupBy("component").agg(
        F.sum("s").alias("_s2"), F.sum("n").alias("_n2")
    )
    zero = F.lit(0.0)
    scored = within.join(between.hint("merge"), "component", "left").select(
        "component", "block_first", "first", "records",
        ((F.col("_s1") + F.coalesce("_s2", zero)) / (F.col("_n1") + F.coalesce("_n2", zero))).alias("average_similarity"),
    )
    groups = number_rows(scored, ["block_first", "first"], row_no="group_id").drop("block_first", "first")
    return Duplicates(pairs, members.drop("_self", "block_first", "_profiles"), groups, df, columns, idx, record_id, null_is_match)
