"""Merkle manifest of a dataset: one tree a source over its rows, one tree over the sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..session import cut_lineage

#: Nodes that one parent has; levels that one block folds, so a block has up to ARITY ** DEPTH nodes.
ARITY, DEPTH = 3, 6
#: Length of a digest in hex.
HEX = 64


def digest_of(*values: Column | str) -> Column:
    """SHA-256 in hex of the values: each `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parents(level: Column) -> Column:
    """The next level of a hex string of nodes: one digest for each ``ARITY`` of them, or fewer at its end."""
    width = HEX * ARITY
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _levels(nodes: Column, n: Column) -> Column:
    """All levels of a block as hex strings, lowest first; ``n`` nodes in its whole tree say when there is one left.

    The strings are binary, in which Spark finds a place without reading what is before it.
    """
    sizes = F.array(*[F.lit(ARITY**k).cast("bigint") for k in range(DEPTH)])
    height = F.size(F.filter(sizes, lambda s: s < n))
    steps = F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), height)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _segments(levels: Column, place: Column) -> Column:
    """(left, right) of each level but the last: the other nodes of the run in which the node above ``place`` stands."""

    def flanks(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(ARITY), k)).cast("int")
        start = at - at % ARITY
        left = F.substring(level, start * HEX + 1, (at - start) * HEX)
        right = F.substring(level, (at + 1) * HEX + 1, (start + ARITY - 1 - at) * HEX)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 in hex of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _fold_blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, n, kept, levels) of nodes (tree, pos, n, digest, kept): each aligned block of a tree in one row."""
    block = F.floor(F.col("pos") / ARITY**DEPTH).cast("bigint").alias("block")
    rows = F.array_sort(F.collect_list(F.struct("pos", "digest", "kept")))
    grouped = nodes.groupBy("tree", block).agg(F.first("n").alias("n"), rows.alias("rows"))
    text = F.array_join(F.col("rows.digest"), "").cast("binary")
    return cut_lineage(grouped.select("tree", "block", "n", F.col("rows.kept").alias("kept"), _levels(text, F.col("n")).alias("levels")))


def _fold_trees(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and (tree, digest) of the roots; the roots of a round's blocks are the next one's nodes."""
    rounds = []
    while True:
        blocks = _fold_blocks(nodes)
        rounds.append(blocks)
        size = F.ceil(F.col("n") / ARITY**DEPTH).cast("bigint").alias("n")
        top = F.element_at("levels", -1).cast("string").alias("digest")
        nodes = blocks.select("tree", F.col("block").alias("pos"), size, top, F.lit(None).cast("int").alias("kept"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, nodes.select("tree", "digest")


@dataclass
class Manifest:
    """Blocks of the sources' trees and of the tree over sources, lowest round first, and the root (null without rows)."""

    rows: list[DataFrame]
    sources: list[DataFrame]
    root: str | None


def build(docs: DataFrame, leaf: Column, source: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows, whose leaves are ``leaf``, a digest in hex over columns of ``docs``.

    Leaves of a source ascend by ``order``, a number (null first; equal numbers by leaf,
    so repeated rows are leaves of their own). While a level has several nodes every
    three consecutive ones (the last run: fewer, even one) become their digest. Roots of the
    sources, null first and then by UTF-8 bytes, form a tree of their own. ``carry`` are
    columns that ``proofs`` gives back with each row. An empty table has no root; columns
    with any names do no harm.

    A row's text is read once, for its digest. Digests are numbered without one big sort and
    meet in aligned blocks of 729 whatever the size of a source, and each round has 729
    times fewer rows. Every round is written to the shared folder.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    carried = F.struct(*[c.alias(n) for n, c in (carry or {order: F.col(f"`{order}`")}).items()])
    slim = cut_lineage(docs.select(key.alias("tree"), F.col(f"`{order}`").alias("place"), leaf.alias("digest"), carried.alias("kept")))
    numbered = number_rows(slim, ["place", "digest"], group=["tree"], row_no="no", group_rows="n")
    rows, roots = _fold_trees(numbered.select("tree", (F.col("no") - 1).alias("pos"), "n", "digest", "kept"))

    # Twelve bytes as two numbers, so that many sources are numbered in ranges too.
    number = lambda a: F.conv(F.rpad(F.hex(F.substring(F.col("tree").cast("binary"), a, 6)), 12, "0"), 16, 10).cast("bigint")
    sources = number_rows(roots.withColumns({"a": number(1), "b": number(7)}), ["a", "b", "tree"], row_no="no", group_rows="n")
    upper, root = _fold_trees(sources.select(F.lit("").alias("tree"), (F.col("no") - 1).alias("pos"), "n", "digest", F.struct("tree", "digest").alias("kept")))
    found = root.first()
    return Manifest(rows, upper, found["digest"] if found else None)


def _descend(rounds: list[DataFrame], above: DataFrame | None, lowest: list[Column]) -> DataFrame:
    """Rows of the lowest round with their paths to the root; ``above``: (tree, subroot, block, path) of the last round's blocks.

    Without it there is one tree, whose path ends at its own root.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    for k in range(len(rounds) - 1, -1, -1):
        joined = rounds[k].withColumns({"path": none, "subroot": F.lit("")}) if above is None else rounds[k].join(above, ["tree", "block"])
        each = lambda row, i: F.struct(
            (F.col("block") * ARITY**DEPTH + i).alias("block"),
            F.substring(F.col("levels")[0], i * HEX + 1, F.lit(HEX)).cast("string").alias("leaf"),
            row.alias("kept"),
            F.concat(_segments(F.col("levels"), i), F.col("path")).alias("path"),
        )
        nodes = joined.select("tree", "subroot", F.explode(F.transform("kept", each)).alias("x"))
        above = nodes.select("tree", "subroot", "x.block", "x.path") if k else nodes.select(*lowest)
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """(carried columns, leaf, subroot, path, root) of each row; ``path`` has (left, right) siblings of each level up to the root."""
    sources = _descend(manifest.sources, None, [F.col("x.kept.tree").alias("tree"), F.col("x.kept.digest").alias("subroot"), F.lit(0).cast("bigint").alias("block"), F.col("x.path").alias("path")])
    rows = _descend(manifest.rows, sources, [F.col("x.kept.*"), F.col("x.leaf").alias("leaf"), "subroot", F.col("x.path").alias("path")])
    return rows.withColumn("root", F.lit(manifest.root).cast("string"))
