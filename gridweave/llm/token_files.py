"""Token ids in binary files: Simple-8b words with escapes and block offsets."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunk_codes, give_back, rows_per_batch, sliced, spread, strings, texts_of, worker_cache

#: Selector, ids in a word, bits of each. Selector 0 marks an escape: the word's other bits
#: are a place in the file's list of ids that need more than 60 bits.
SELECTORS = (
    (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7),
    (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60),
)
BLOCK_IDS = 4096
#: Ids of a file at most; a longer document is a file alone. Bytes of text of a shard, about.
FILE_IDS, SHARD_BYTES = 250_000, 32 << 20
#: Text bytes that a worker encodes at a time; pieces that it keeps encoded.
SLICE_BYTES = 2 << 20
CACHED = 40_000
#: Frequent pieces that are encoded before all others, and characters of each, at most; documents, about, of their sample.
COMMON, COMMON_CHARS, SAMPLE_DOCS = 160_000, 64, 8_000
#: Rows that a worker is handed at a time while files are written, so texts and ids of few documents are in memory.
BATCH_ROWS = 1000
#: Shards at most; beyond, shards have more files.
SHARDS = 20_000
#: Bytes of files in a page and in a row group of their table, about; what writers and readers hold at once.
PAGE_BYTES, GROUP_BYTES = 1 << 20, 8 << 20
_HEAD = "<4sIIIQQQ"
_MAGIC = b"GWS8"
_FILES = "shard int, part int, first bigint, n_docs bigint, n_ids bigint, data binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, escaped ids) of unsigned ids.

    Each word takes as many of the next ids as any selector allows; none reaches over
    the end of a block.
    """
    ids = ids if isinstance(ids, np.ndarray) and ids.dtype.kind == "u" else np.asarray(ids, np.uint64)
    n, blocks, top = len(ids), -(-len(ids) // BLOCK_IDS), int(ids.max(initial=0))
    # The place in SELECTORS of the first that has bits enough for an id; none has for what is behind the end of a block.
    least = np.full((blocks, BLOCK_IDS), 255, np.uint8)
    flat = least.reshape(-1)[:n]
    flat[:] = 0
    for _, _, bits in SELECTORS:
        if top >> bits:
            flat += ids >= ids.dtype.type(1 << bits)
    most = {1: np.pad(least, ((0, 0), (0, SELECTORS[0][1])), constant_values=255)}
    for size in (1, 2, 4, 8, 16):
        most[2 * size] = np.maximum(most[size][:, :-size], most[size][:, size:])
    # Where a selector can't pack, none before it can: their number is the place of the first that can.
    place = np.zeros((blocks, BLOCK_IDS), np.uint8)
    for k, (_, count, _) in enumerate(SELECTORS):
        size = 1 << count.bit_length() - 1
        place += np.maximum(most[size][:, :BLOCK_IDS], most[size][:, count - size : count - size + BLOCK_IDS]) > k
    place = place.reshape(-1)
    at, starts, steps = 0, bytearray(n), np.array([count for _, count, _ in SELECTORS] + [1], np.uint8)[place].tobytes()
    while at < n:
        starts[at] = 1
        at += steps[at]
    begin = np.flatnonzero(np.frombuffer(starts, np.uint8))
    chosen, words = place[begin], np.zeros(len(begin), np.uint64)
    for at, (selector, count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == at)
        word, first = np.full(len(rows), selector << 60, np.uint64), begin[rows]
        for k in range(count if len(rows) else 0):
            word |= ids[first + k].astype(np.uint64) << np.uint64(k * bits)
        words[rows] = word
    escaped = np.flatnonzero(chosen == len(SELECTORS))
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(begin, np.arange(0, n + BLOCK_IDS, BLOCK_IDS)[: blocks + 1])
    return words, offsets.astype(np.uint64), ids[begin[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole words: all words of one selector at a time."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.ones(16, np.int64)
    for selector, count, _ in SELECTORS:
        sizes[selector] = count
    begin = np.cumsum(sizes[kind]) - sizes[kind]
    out = np.zeros(int(sizes[kind].sum()), np.uint64)
    for selector, count, bits in SELECTORS:
        rows = np.flatnonzero(kind == selector)
        for k in range(count):
            out[begin[rows] + k] = words[rows] >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)
    rows = np.flatnonzero(kind == 0)
    out[begin[rows]] = escapes[words[rows].astype(np.int64)]
    return out


def file_bytes(doc_ids: list[int | None], runs: list[np.ndarray]) -> bytes:
    """A file: head, documents (id, null flag, ids), block offsets, escapes, words."""
    ids = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
    words, offsets, escapes = pack(ids)
    head = struct.pack(_HEAD, _MAGIC, 1, BLOCK_IDS, len(doc_ids), len(ids), len(words), len(escapes))
    parts = (
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "u1"),
        np.array([len(r) for r in runs], "<u8"),
        offsets.astype("<u8"),
        escapes.astype("<u8"),
        words.astype("<u8"),
    )
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Reads a file; ``ids(a, b)`` decodes only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        magic, version, self.block, docs, self.n, words, escapes = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = part("<i8", docs), part("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.lens = part("<u8", docs).astype(np.int64)
        self.offsets = part("<u8", -(-self.n // self.block) + 1).astype(np.int64)
        self.escapes, self.words = part("<u8", escapes).astype(np.uint64), part("<u8", words).astype(np.uint64)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = a // self.block, -(-b // self.block)
        got = unpack(self.words[self.offsets[first] : self.offsets[last]], self.escapes)
        return got[a - first * self.block : b - first * self.block]


def _encoder(load: Callable) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """f(pieces) -> start of each piece's ids, and the ids, by the library; a worker keeps what it encoded in a bounded cache."""
    tokenizer = load()
    known, model = worker_cache("token pieces", CACHED), tokenizer.model
    letters = [chr(c) for c in range(128, 256) if chr(c).isalpha()]
    alphabet = str.maketrans({c: tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def add(pieces: list[str]) -> None:
        rest = []
        for p in pieces:
            if p.isalpha() and (p.isascii() or max(p) <= "\xff"):
                ids = [t.id for t in model.tokenize(p if p.isascii() else p.lower().translate(alphabet))]
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(p)
        for p, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start of each word's ids, and the ids."""
        if len(known) > CACHED:
            known.clear()
        missing = [w for w in words if w not in known]
        for i in range(0, len(missing), 10_000):
            add(missing[i : i + 10_000])
        raw = [known[w] for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        return np.concatenate([[0], np.cumsum(lens)]), np.frombuffer(b"".join(raw), "<u4")

    return encoded


def _common(docs: DataFrame, load: Callable, n: int, text: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The most frequent pieces of about ``SAMPLE_DOCS`` of the ``n`` documents, and their ids.

    They are ``COMMON`` pieces of ``COMMON_CHARS`` characters at most, so the driver may encode them.
    """

    def pieces(batches):
        for b in sliced(batches, "text", SLICE_BYTES):
            for part in _parts(chunk_codes(texts_of(b, "text"))[1].dictionary):
                yield pa.RecordBatch.from_arrays([pc.cast(pc.unique(part), pa.string())], names=["piece"])

    sample = docs.select(F.col(f"`{text}`").cast("string").alias("text")).sample(min(1.0, SAMPLE_DOCS / max(1, n)), 1)
    counted = sample.mapInArrow(pieces, "piece string").where(F.length("piece") <= COMMON_CHARS).groupBy("piece").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "piece").limit(COMMON).select("piece")
    found = top.toArrow().column("piece").combine_chunks().cast(pa.large_string())
    starts, values = _encoder(load)(strings(found))
    return found, starts, values.copy()


def encode(docs: DataFrame, load: Callable, end_id: int, n: int, bounds: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, doc_id, ids) of the ``n`` rows, with little-endian 32-bit ids. ``load()`` gives the tokenizer in the task.

    Texts are cut at ASCII white space, of which the tokenizer keeps nothing. The most frequent
    parts of a sample are encoded first and then known to every task; any other distinct part is
    encoded by the library once for a worker, as far as its bounded cache reaches. The sample
    spares work and changes no id. Closing marks are encoded apart from a word of
    ASCII or Latin-1 letters before them, as the tokenizer parts them too; such a word alone,
    which composing and splitting leave whole, goes to the library's model at once, its letters
    as the library's byte alphabet writes them. All other parts go to the library whole.
    """
    common, common_starts, common_ids = _common(docs, load, n, text)

    def run(batches):
        encoded = _encoder(load)
        for b in sliced(batches, "text", SLICE_BYTES):
            offsets, coded = chunk_codes(texts_of(b, "text"))
            stems, tails = (pc.dictionary_encode(x) for x in _parts(coded.dictionary))
            pieces = pa.concat_arrays([stems.dictionary, tails.dictionary])
            known = pc.index_in(pieces, common)
            new = np.asarray(known.is_null())
            starts, ids = encoded(strings(pieces.filter(pa.array(new))))
            starts, ids = np.concatenate([common_starts, common_starts[-1] + starts[1:]]), np.concatenate([common_ids, ids])
            place = np.where(new, len(common) + np.cumsum(new) - 1, np.asarray(known.fill_null(0)))
            pairs = np.stack([np.asarray(stems.indices, np.int64), len(stems.dictionary) + np.asarray(tails.indices, np.int64)], axis=1)
            starts, ids = spread(np.arange(0, pairs.size + 1, 2), place[pairs.ravel()], starts, ids)
            at, ids = spread(offsets, np.asarray(coded.indices, np.int64), starts, ids)
            runs = [ids[s:e].astype("<u4").tobytes() + struct.pack("<I", end_id) for s, e in zip(at, at[1:])]
            keys = b.column("doc_id")
            shard = np.searchsorted(bounds, np.asarray(pc.fill_null(keys, np.iinfo(np.int64).min)), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), keys, pa.array(runs, pa.binary())], names=["shard", "doc_id", "ids"])
        give_back()

    slim = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "shard int, doc_id bigint, ids binary")


def _parts(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of ASCII or Latin-1 letters and their closing marks; any other piece whole and no marks. ASCII case is folded, as the tokenizer does.

    Lower case or composition can join other letters to what is behind them: a capital dotted I
    becomes two characters, of which the library takes the second with the mark that follows.
    """
    stems = pc.utf8_rtrim(pieces, characters=punctuation)
    tails = pc.replace_substring_regex(pieces, f"^.*[^{re.escape(punctuation)}]", "")
    word = pc.match_substring_regex(stems, "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$")
    return pc.ascii_lower(pc.if_else(word, stems, pieces)), pc.if_else(word, tails, "")


def write_files(docs: DataFrame, path: str, load: Callable, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending order of ids.

    A null text counts as empty; null ids come first; repeated rows stay, in the order of
    their ids; other columns are not read; an empty table gives no files. Files are rows
    (shard, part, first, n_docs, n_ids, data) of a table, so any store that Spark reaches can
    hold them; ``data`` is the file of ``file_bytes``, ``first`` the ids before it in its shard. Documents are dealt to shards by
    quantiles of their ids, so only encoded ids are shuffled, once, and each shard is
    sorted for itself; a shard's files are written as its rows stream by. Pages end by their size after
    any row, not only after the 100 rows that Parquet waits for by default: 100 files are some 50 MB,
    which each task would compress and uncompress at once in buffers beside the heap.
    """
    key = F.col(f"`{doc_id}`").cast("bigint")
    stats = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(f"`{text}`"))).alias("bytes")).first()
    shards = int(min(max(1, (stats["bytes"] or 0) // SHARD_BYTES), SHARDS, max(1, stats["n"])))
    steps = [k / shards for k in range(1, shards)]
    bounds = docs.select(key.alias("k")).approxQuantile("k", steps, max(1e-4, 0.1 / shards)) if steps else []
    cuts = np.unique(np.array(bounds, np.int64))

    def write(batches):
        held, total, place = [], 0, (None, 0, 0)

        def done():
            nonlocal held, total, place
            runs = [np.frombuffer(x, "<u4") for _, x in held]
            out = [*place, len(held), total, file_bytes([d for d, _ in held], runs)]
            held, total, place = [], 0, (place[0], place[1] + 1, place[2] + total)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds)], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 200):
                for shard, doc, ids in zip(*[b.column(c).slice(at, 200).to_pylist() for c in ("shard", "doc_id", "ids")]):
                    if held and (shard != place[0] or total + len(ids) // 4 > FILE_IDS):
                        yield done()
                    if shard != place[0]:
                        place = (shard, 0, 0)
                    held.append((doc, ids))
                    total += len(ids) // 4
        if held:
            yield done()
        give_back()

    names = ["shard", "part", "first", "n_docs", "n_ids", "data"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        rows = encode(docs, load, end_id, stats["n"], cuts, doc_id, text)
        dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
        pages = {"parquet.page.size": PAGE_BYTES, "parquet.page.size.row.check.min": 1, "parquet.block.size": GROUP_BYTES}
        dealt.mapInArrow(write, _FILES).write.options(**pages).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, decoded from the files.

    ``start`` counts the ids before a document's in all files; sums over shards, of which
    there are ``SHARDS`` at most, are all that meets in one task or is broadcast, so files
    stay where they are read.
    """
    files = spark.read.schema(_FILES).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    base = sums.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for base, data in zip(b.column("base").to_pylist(), b.column("data")):
                f = TokenFile(data.as_py())
                ids, at = f.ids().astype("<u4"), np.concatenate([[0], np.cumsum(f.lens)])
                raw = [ids[s:e].tobytes() for s, e in zip(at, at[1:])]
                columns = (f.doc_ids, pa.int64()), (base + at[:-1], pa.int64()), (f.lens, pa.int64()), ([zlib.crc32(x) for x in raw], pa.int64()), (raw, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("base"), "data")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
