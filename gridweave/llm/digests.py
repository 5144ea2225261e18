"""Similarity digests of documents: improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sliced, texts_of

#: Bytes of a feature; consecutive windows that compete; runs that a window must win to be a feature.
WINDOW, RUN, WINS = 64, 64, 16
#: Steps into which the entropy of a window is graded; a window of one byte alone has grade 0, one of different bytes the last.
GRADES = 1000
#: Bits of a filter, bits that a feature sets, features of a filter.
BITS, PROBES, FEATURES = 2048, 5, 160
#: Part of the possible overlap beyond chance that two filters must share to be alike at all.
CUTOFF = 0.3
#: Bytes that are graded at a time; a longer text is graded in pieces.
PIECE = 1 << 20
#: Text bytes of a shard, about; shards at most.
SHARD_BYTES, SHARDS = 16 << 20, 20_000
_WORST, _PLACE = 1 << 40, 21
_HEAD = "<II"


def grades(data: np.ndarray) -> np.ndarray:
    """Grade of the entropy of each window of ``data``.

    The entropy follows from the counts of the bytes in a window. From one window to the next
    one byte goes and one comes, and how often each is in the window is found by comparing
    the data with itself at each shift. Sums are of whole numbers, so a window's grade
    doesn't depend on what lies before it.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    behind, ahead = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)  # equal bytes in the window that ends or begins here
    same = np.empty(len(data), bool)
    for k in range(1, WINDOW):
        np.equal(data[:-k], data[k:], out=same[k:])
        behind[k:] += same[k:]
        ahead[:-k] += same[k:]
    count = np.arange(WINDOW + 1)
    part = np.round(count * np.log2(np.maximum(count, 1)) * (1 << 32)).astype(np.int64)
    step = part[1:] - part[:-1]  # what a sum gains when a count of k - 1 becomes k
    gain, loss = step[behind - 1], step[ahead - 1]
    sums = np.empty(n, np.int64)
    sums[0] = part[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(gain[WINDOW:] - loss[: n - 1], out=sums[1:])
    sums[1:] += sums[0]
    return GRADES - (sums * GRADES // part[WINDOW])


def _valid(starts: np.ndarray, size: int) -> np.ndarray:
    """True for the windows of joined texts that lie in one text."""
    ends = np.repeat(starts[1:], np.diff(starts))[: max(size - WINDOW + 1, 0)]
    return np.arange(len(ends)) + WINDOW <= ends


def grade_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many windows of the joined texts have each grade."""
    out = np.zeros(GRADES + 1, np.int64)
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE + WINDOW - 1]
        inside = np.clip(starts - a, 0, len(part))
        out += np.bincount(grades(part)[_valid(inside, len(part))], minlength=GRADES + 1)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each grade: the rarer in the corpus the smaller; equally rare ones by grade."""
    ranks = np.empty(GRADES + 1, np.int64)
    ranks[np.lexsort((np.arange(GRADES + 1), counts))] = np.arange(GRADES + 1)
    return ranks


def _winners(keys: np.ndarray) -> np.ndarray:
    """How many runs of ``RUN`` places each place wins: the smallest key, the first of equal ones. Runs may reach over both ends."""
    n = len(keys)
    wide = np.full(n + 2 * (RUN - 1), _WORST << _PLACE, np.int64)
    wide[RUN - 1 : RUN - 1 + n] = keys << _PLACE
    wide += np.arange(len(wide))
    size = 1
    while size < RUN:
        step = min(size, RUN - size)
        wide = np.minimum(wide[:-step], wide[step:])
        size += step
    return np.bincount(wide & ((1 << _PLACE) - 1), minlength=n + 2 * (RUN - 1))[RUN - 1 : RUN - 1 + n]


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hash of the window at each place."""
    words = np.ascontiguousarray(data[places[:, None] + np.arange(WINDOW)]).view("<u8")
    out = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    for w in words.T:
        out = (out ^ w) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


def _features(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of joined texts, in order of their places, each hash once a text.

    A window is a feature when it wins ``WINS`` of the runs that it is in; the rarest one
    of a text, the first of equal ones, wins all of its runs. A text shorter than a window
    is a feature whole.
    """
    owners, hashes = [], []
    halo = RUN - 1
    for a in range(0, len(data), PIECE):
        low, high = max(0, a - halo), min(len(data), a + PIECE + halo + WINDOW - 1)
        part = data[low:high]
        valid = _valid(np.clip(starts - low, 0, high - low), high - low)
        if len(valid):
            mine = slice(a - low, min(len(valid), a - low + PIECE))
            won = _winners(np.where(valid, ranks[grades(part)], _WORST))[mine] >= WINS
            places = a + np.flatnonzero(won & valid[mine])
            owners.append(np.searchsorted(starts, places, side="right") - 1)
            hashes.append(_hashes(data, places))
    short = np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < WINDOW))
    small = [int.from_bytes(hashlib.sha256(data[starts[t] : starts[t + 1]].tobytes()).digest()[:8], "little") for t in short]
    text = np.concatenate([*owners, short])
    h = np.concatenate([*hashes, np.array(small, np.uint64)])
    # Texts in order; within a text the order of places stays.
    order = np.argsort(text, kind="stable")
    text, h = text[order], h[order]
    by = np.lexsort((np.arange(len(h)), h, text))
    again = np.zeros(len(h), bool)
    again[by[1:]] = (h[by][1:] == h[by][:-1]) & (text[by][1:] == text[by][:-1])
    return text[~again], h[~again]


class Digest:
    """Chained Bloom filters and the number of features in each."""

    def __init__(self, filters: np.ndarray, sizes: np.ndarray):
        self.filters, self.sizes = filters, sizes
        self.ones = np.bitwise_count(filters).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, hashes: np.ndarray) -> Digest:
        n = -(-len(hashes) // FEATURES)
        bits = np.zeros((n, BITS), np.uint8)
        row = np.arange(len(hashes)) // FEATURES
        width = BITS.bit_length() - 1
        for k in range(PROBES):
            bits[row, (hashes >> np.uint64(k * width) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        return cls(np.packbits(bits, axis=1, bitorder="little").view("<u8"), np.bincount(row, minlength=n))

    def text(self) -> str:
        """Printable: number of filters, features of the last one, then the filters, in base64."""
        head = struct.pack(_HEAD, len(self.sizes), self.sizes[-1] if len(self.sizes) else 0)
        return base64.b64encode(head + self.filters.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Digest:
        data = base64.b64decode(text)
        n, last = struct.unpack_from(_HEAD, data)
        sizes = np.full(n, FEATURES, np.int64)
        sizes[n - 1 :] = last
        return cls(np.frombuffer(data, "<u8", offset=struct.calcsize(_HEAD)).reshape(n, BITS // 64), sizes)

    def likeness(self, other: Digest) -> float:
        """0 to 1: each filter of the shorter digest by its best match in the other, weighted by its features.

        The overlap of two filters counts from ``CUTOFF`` of the way between what chance gives and the most
        possible. Two digests without features are alike, one of them isn't like any other.
        """
        a, b = (self, other) if (len(self.sizes), self.sizes.sum()) <= (len(other.sizes), other.sizes.sum()) else (other, self)
        if not len(a.sizes):
            return float(not len(b.sizes))
        total = 0.0
        for words, ones, size in zip(a.filters, a.ones, a.sizes):
            shared = np.bitwise_count(words & b.filters).sum(axis=1, dtype=np.int64)
            most = np.minimum(ones, b.ones)
            chance = ones * b.ones / BITS
            from_ = chance + CUTOFF * (most - chance)
            total += size * float(np.clip((shared - from_) / np.maximum(most - from_, 1e-9), 0.0, 1.0).max())
        return total / float(a.sizes.sum())


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts one after another, and where each starts, with the end."""
    data = texts.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def digests(texts: pa.Array, ranks: np.ndarray) -> list[Digest]:
    """The digest of each text (large_string)."""
    if not len(texts):
        return []
    data, starts = _joined(texts)
    owner, hashes = _features(data, starts, ranks)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [Digest.of(hashes[s:e]) for s, e in zip(at, at[1:])]


def fit_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the grades by how rare they are among all windows of all texts; a row a grade comes to the driver."""

    def count(batches):
        out = np.zeros(GRADES + 1, np.int64)
        for b in sliced(batches, "text", PIECE):
            out += grade_counts(*_joined(texts_of(b, "text")))
        used = np.flatnonzero(out)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used])], names=["grade", "n"])

    counts = np.zeros(GRADES + 1, np.int64)
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    for r in slim.mapInArrow(count, "grade int, n bigint").groupBy("grade").agg(F.sum("n").alias("n")).collect():
        counts[r["grade"]] = r["n"]
    return rarity(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row.

    Each window of 64 bytes has a grade, its entropy in thousandths; ``ranks`` (see
    ``fit_ranks``) order grades by rarity. Windows that are the rarest in 16 of the runs of
    64 windows around them are the features; in order of their places they fill Bloom
    filters of 2,048 bits with up to 160 features each, one filter after another. Equal texts have
    equal fingerprints. A null text counts as empty and has no filter; a text shorter than a
    window is a feature whole; repeated rows stay; other columns are not read; an empty
    table gives no rows. Long texts are graded in pieces that overlap, so memory stays
    small.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, "text", PIECE):
            prints = [d.text() for d in digests(texts_of(b, "text"), ranks)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])
        give_back()

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def half_edited(text: str, following: str) -> str:
    """The text whose last floor(n / 2) code points are replaced by the first as many (or all) of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def edits(docs: DataFrame, ranks: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edit with the next one's text, and how alike they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next);
    documents follow each other by ascending id (a whole number; null first, equal ids by
    text), the first follows the last. A lone document follows itself.

    Texts are shuffled once: documents are dealt to shards by quantiles of their ids and
    sorted in each; the first document of a shard is also dealt to the shard before it,
    behind its last one. What comes to the driver is an id a shard.
    """
    key = F.col(f"`{doc_id}`").cast("bigint")
    stats = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))).alias("bytes")).first()
    shards = int(min(max(1, (stats["bytes"] or 0) // SHARD_BYTES), SHARDS, max(1, stats["n"])))
    steps = [k / shards for k in range(1, shards)]
    cuts = np.unique(np.array(docs.select(key.alias("k")).approxQuantile("k", steps, max(1e-4, 0.1 / shards)) if steps else [], np.int64))
    slim = docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def shard_of(keys: pa.Array) -> np.ndarray:
        at = np.searchsorted(cuts, np.asarray(pc.fill_null(keys, 0), dtype=np.int64), side="right")
        return np.where(np.asarray(keys.is_null()), 0, at)

    def firsts(batches):
        found: dict[int, int | None] = {}
        for b in batches:
            keys = b.column("doc_id")
            for s, k in zip(shard_of(keys).tolist(), keys.to_pylist()):
                if s not in found or (found[s] is not None and (k is None or k < found[s])):
                    found[s] = k
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["shard", "k"])

    heads = slim.select("doc_id").mapInArrow(firsts, "shard int, k bigint").groupBy("shard").agg(F.max(F.col("k").isNull()).alias("none"), F.min("k").alias("k")).orderBy("shard").collect()
    before = {(None if r["none"] else r["k"]): heads[i - 1]["shard"] for i, r in enumerate(heads)}

    def deal(batches):
        for b in batches:
            keys = b.column("doc_id")
            own = shard_of(keys)
            guests = [(i, before[k]) for i, k in enumerate(keys.to_pylist()) if k in before]
            take = np.concatenate([np.arange(len(keys)), np.array([i for i, _ in guests], np.int64)])
            shard = np.concatenate([own, np.array([s for _, s in guests], np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(np.arange(len(take)) >= len(keys)), keys.take(pa.array(take)), b.column("text").take(pa.array(take))],
                names=["shard", "guest", "doc_id", "text"],
            )

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        """Rows with the digest and text of the row behind them. Guests end a shard and make no row."""
        held = None  # shard, guest, id, text and digest of the last row seen
        for b in sliced(batches, "text", PIECE):
            texts = texts_of(b, "text")
            own = digests(texts, ranks)
            rows = [*([held] if held else []), *zip(*[b.column(c).to_pylist() for c in ("shard", "guest", "doc_id")], texts.to_pylist(), own)]
            held = rows[-1]
            done = [(r, s) for r, s in zip(rows, rows[1:]) if not r[1] and r[0] == s[0]]
            edited = [half_edited(r[3], s[3]) for r, s in done]
            prints: list[Digest] = []
            sizes = np.cumsum([len(x) for x in edited]) // PIECE
            for piece in np.unique(sizes):
                some = [x for x, p in zip(edited, sizes) if p == piece]
                prints += digests(pa.array(some, pa.large_string()), ranks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r, _ in done], pa.int64()),
                    pa.array([len(r[3]) for r, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array([r[4].text() for r, _ in done], pa.string()),
                    pa.array([d.text() for d in prints], pa.string()),
                    pa.array([r[4].likeness(d) for (r, _), d in zip(done, prints)], pa.float64()),
                    pa.array([r[4].likeness(s[4]) for r, s in done], pa.float64()),
                ],
                names=names,
            )
        give_back()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    dealt = slim.mapInArrow(deal, "shard int, guest boolean, doc_id bigint, text string")
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(pairs, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
