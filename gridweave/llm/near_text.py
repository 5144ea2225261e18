"""Near-duplicate texts by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linkage import connected_components
from ..session import cut_lineage
from .common import distinct, rows_per_batch, shingles, sliced, small_batches, texts_of, token_hashes

#: Words of a k-mer, and the least similarity of linked texts.
SIZE, SIMILARITY = 5, 0.8
# (least k-mers, end, k-mers of a sketch, tables). Two texts with similarity 0.8 share one
# sketch of 6 k-mers with probability 0.8^6, and one of 30 with 0.9998; short texts have
# few k-mers, so they take sketches of 3, of which they share one of 12 with 0.998 or more.
# Many k-mers a sketch keep apart texts that only share a line or a passage. The ranges
# overlap by the ratio 0.8, so any two similar texts have tables in common.
BANDS = ((1, 50, 3, 12), (40, None, 6, 30))
#: Texts of a group that a task compares with as many others at a time.
BLOCK = 512
#: Rows (texts, or pairs with the words of both) that a Python worker is handed at a time.
BATCH_ROWS = 1_000
#: Hashes of k-mers that a long text holds at a time; it takes its tables a few at a time.
HASHES = 1 << 18


def sketches(words: np.ndarray, bands=BANDS, size: int = SIZE) -> np.ndarray:
    """One number for each table: its smallest occurrence-labelled k-mers, hashed in their order in the text.

    A text with fewer words than ``size`` has one k-mer, one with fewer k-mers than a
    sketch takes gives all of them; a text without words has no sketch.
    """
    g = shingles(words, size)
    if not len(g):
        return g
    order = np.argsort(g, kind="stable")
    new = np.concatenate([[True], g[order][1:] != g[order][:-1]])
    nth = np.empty(len(g), np.uint64)
    nth[order] = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    labelled = (g ^ (nth * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    labelled ^= labelled >> np.uint64(31)
    all_seeds, out = np.random.default_rng(11).integers(1, 1 << 63, sum(b[3] for b in bands), dtype=np.uint64), []
    for least, end, kmers, tables in bands:
        seeds, all_seeds = all_seeds[:tables], all_seeds[tables:]
        if len(g) < least or (end is not None and len(g) >= end):
            continue
        k = min(kmers, len(g))
        at = np.concatenate([_smallest(labelled, some, k) for some in np.array_split(seeds, min(tables, 1 + len(g) * tables // HASHES))])
        one = seeds.copy()
        for j in range(k):
            one = (one ^ labelled[at[:, j]]) * np.uint64(0x94D049BB133111EB)
            one ^= one >> np.uint64(32)
        out.append(one)
    return np.concatenate(out)


def _smallest(labelled: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each seed the places of the ``k`` k-mers with the smallest hashes, in text order."""
    if k == len(labelled):
        return np.tile(np.arange(k), (len(seeds), 1))
    h = (labelled ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.sort(np.argpartition(h, k - 1, axis=1)[:, :k], axis=1)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits (insert, delete, replace) between two word sequences, if at most ``most``; else ``most + 1``.

    Banded alignment: the dynamic programme keeps to the diagonals that ``most`` edits can
    reach. A column of the band is a row of bits that tell where neighbouring cells differ
    by one; it slides along the longer text, first down its lowest diagonal, then along
    its last row.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    most_asked, most = most, min(most, n)
    if n - m > most:
        return most_asked + 1
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * most + 2
    full = (1 << width) - 1
    up, down = (full << (width - most - 1)) & full, 0
    score, low, last = most, 1 << (width - 1), 1 << (width - 2)
    limit = 2 * most + m - n
    for j, y in enumerate(b.tolist()):
        shift = most + 1 - width + j
        hit = where.get(y, 0)
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        diag = (((hit & up) + up) ^ up | hit | down) & full
        plus = down | (full & ~(diag | up))
        minus = diag & up
        if j < n - most:
            score += not diag & low
        else:
            score += bool(plus & last) - bool(minus & last)
            last >>= 1
        if score > limit:
            return most_asked + 1
        below = diag >> 1
        up = minus | (full & ~(below | plus))
        down = below & plus
    return score if score <= most else most_asked + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, size: int = SIZE) -> bool:
    """True when the shingle sets have a Jaccard similarity of ``least`` and the banded alignment, too, finds one of ``least``."""
    x, y = distinct(shingles(a, size)), distinct(shingles(b, size))
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return both >= least * (len(x) + len(y) - both) - 1e-9 and edit_distance(a, b, most) <= most


def _digest(words: np.ndarray, text: str) -> bytes:
    """Equal for texts with the same words; a text without words has a digest of its characters."""
    data = b"w" + words.tobytes() if len(words) else b"t" + text.encode("utf-8", "replace")
    return hashlib.sha256(data).digest()[:14]


def _read_words(batches):
    """Digest and words of each text, batch by batch."""
    for b in sliced(batches, "text"):
        texts = texts_of(b, "text")
        offsets, words = token_hashes(texts)
        each = [words[s:e] for s, e in zip(offsets, offsets[1:])]
        yield b, [_digest(w, t.as_py()) for w, t in zip(each, texts)], each


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, size: int = SIZE, bands: tuple = BANDS
) -> DataFrame:
    """(doc_id, class_id, text_key, kept) for each row.

    Two texts are linked when at least ``least`` of their five-word shingles (lower-case
    words) are shared, as a Jaccard similarity, and banded alignment finds an edit
    similarity of ``least`` too. Classes are what links join; a class has the smallest
    id of its members as its id, and that row is kept. Equal word sequences are one
    text; texts without words are equal when their characters are (null as empty).
    Repeated rows are in one class, and if they have its id, all are kept. A null id is
    larger than all others. An empty table gives no rows, other columns are not read.
    ``text_key`` (a hash of the text) tells texts apart that come with the same id.

    Equal texts fold first, so copies cost one row each. Texts that share a sketch in
    a table meet in a cell. The member that shares most cells leads the cell, and each
    member is compared with it: that finds the classes around a centre at one
    comparison a text. The cells of one leader make a group. In groups that still span
    several classes, the texts outside the largest class are compared with all texts of
    the group, block against block, so every two texts of a cell that are not in one
    class already have been compared; blocks give links only, not pairs.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.col(f"`{text}`").cast("string")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))

    def sketch(batches):
        for b, digests, words in _read_words(batches):
            rows = [sketches(w, bands, size).view(np.int64) for w in words]
            lens = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("text_key"),
                    pa.array(digests, pa.binary()),
                    pa.array([max(1, len(w) - size + 1) for w in words], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(lens), pa.array(flat)),
                ],
                names=["doc_id", "text_key", "node", "n", "sketch"],
            )

    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        rows = cut_lineage(slim.mapInArrow(sketch, f"doc_id {kind}, text_key bigint, node binary, n int, sketch array<bigint>"))
        row_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
        nodes = cut_lineage(rows.groupBy("node").agg(F.min(row_id).alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
        filed = nodes.select("node", "n", F.explode("sketch").alias("cell"))
        full = filed.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1")
        filled = cut_lineage(filed.join(full, "cell"))
        weight = filled.groupBy("node").agg(F.sum("held").alias("weight"))
        weighed = filled.select("cell", "node").join(weight, "node")
        lead = weighed.groupBy("cell").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
        groups = cut_lineage(weighed.select("cell", "node").join(lead, "cell").select("lead", "node").distinct())
        words = cut_lineage(_words_of(slim, weight.join(nodes, "node").select("node", "first.doc_id", "first.text_key")))

        stars = cut_lineage(_compare(groups.where("lead <> node"), words, least, size))
        roots = cut_lineage(connected_components(stars, "lead", "node"))
        rest = cut_lineage(_compare_blocks(groups, roots, words, least, size))
        if rest.limit(1).count():
            roots = connected_components(stars.unionByName(rest), "lead", "node")

    placed = nodes.select("node", "first")
    placed = placed.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("first").alias("head"))
    known = placed.join(names, "component").select("node", "head")
    # Copies of one text may be many: they are the left side, which Spark can split.
    return rows.select("doc_id", "text_key", "node").join(known, "node", "left").select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        "text_key",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("kept"),
    )


def _words_of(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the texts that are to be compared, each read from one of its rows."""

    def read(batches):
        for b, _, words in _read_words(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([w.tobytes() for w in words], pa.binary())], names=["node", "words"])

    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key"))
    rows = slim.alias("d").join(wanted.alias("w"), same).select("text", "node").dropDuplicates(["node"])
    return rows.mapInArrow(read, "node binary, words binary")


def _compare(pairs: DataFrame, words: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (lead, node) of similar texts. A leader has many pairs, so its words join last, from the side that isn't split."""

    def check(batches):
        for b in batches:
            good = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least, size)
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())
            ]
            yield b.select(["lead", "node"]).filter(pa.array(good, pa.bool_()))

    near = pairs.join(words.select("node", F.col("words").alias("y")), "node")
    both = near.join(words.select(F.col("node").alias("lead"), F.col("words").alias("x")), "lead")
    return both.select("lead", "node", "x", "y").mapInArrow(check, "lead binary, node binary")


def _compare_blocks(groups: DataFrame, roots: DataFrame, words: DataFrame, least: float, size: int) -> DataFrame:
    """Links (lead, node) between classes of one group: the texts outside its largest class against all of them.

    The former come in blocks and so do the latter, of some ``BLOCK`` texts by the hash
    of the text, so no group is put in order; a task has one block of each. A group of one
    block, as nearly all are, sends each of its texts to one task once or twice.
    """
    at = groups.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    open_groups = at.groupBy("lead").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("lead")
    at = cut_lineage(at.join(open_groups, "lead"))
    main = at.groupBy("lead", "root").agg(F.count("*").alias("held")).groupBy("lead").agg(
        F.max_by("root", F.struct("held", "root")).alias("main"), F.sum("held").alias("all"), F.max("held").alias("inside")
    )
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    all_of = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    mine = lambda n, c: F.pmod(F.xxhash64("node"), F.col(n)).cast("int").alias(c)
    placed = at.join(main, "lead").withColumn("os", blocks(F.col("all") - F.col("inside"))).withColumn("cs", blocks(F.col("all")))
    outside = placed.where("root <> main").select("lead", "node", "root", mine("os", "o"), all_of("cs", "c"), F.lit(True).alias("asks"))
    every = placed.select("lead", "node", "root", all_of("os", "o"), mine("cs", "c"), F.lit(False).alias("asks"))
    rows = outside.unionByName(every).join(words, "node").select("lead", "o", "c", "asks", "node", "root", "words")

    def check(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        side = lambda of: list(zip(*[table.filter(pa.array(of)).column(c).to_pylist() for c in ("node", "root", "words")]))
        return pa.table(dict(zip(("lead", "node"), map(pa.array, _links(side(asks), side(~asks), least, size), [pa.binary()] * 2))))

    return rows.groupBy("lead", "o", "c").applyInArrow(check, "lead binary, node binary").distinct()


def _links(left: list, right: list, least: float, size: int, columns: int = 4096) -> tuple[list, list]:
    """Similar texts of different classes. Shared shingles are counted as products of 0/1 matrices, some shingles at a time."""
    a, b = [[distinct(shingles(np.frombuffer(r[2], np.uint64), size)) for r in rows] for rows in (left, right)]
    if not a or not b:
        return [], []
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    counts = np.zeros((len(a), len(b)), np.float32)

    def ones(lists: list, cut: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lists), len(cut)), np.float32)
        for i, x in enumerate(lists):
            k = np.minimum(np.searchsorted(cut, x), len(cut) - 1)
            out[i, k[cut[k] == x]] = 1
        return out

    for s in range(0, len(shared), columns):
        cut = shared[s : s + columns]
        counts += ones(a, cut) @ ones(b, cut).T
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    able = counts >= least * (n[:, None] + m[None, :] - counts) - 1e-3
    links = []
    for i, j in np.argwhere(able).tolist():
        if left[i][1] != right[j][1] and similar(np.frombuffer(left[i][2], np.uint64), np.frombuffer(right[j][2], np.uint64), least, size):
            links.append((left[i][0], right[j][0]))
    return [x for x, _ in links], [y for _, y in links]


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each class of ``near_classes``, all columns unchanged.

    Rows that repeat an id and a text are one document, of which one row stays. An id
    that comes with several texts, or no id, names several documents, each judged for itself.
    """
    heads = near_classes(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("key"))
    held = keyed.join(heads, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    return held.dropDuplicates(["id", "key"]).select("row.*")
