"""Byte-level BPE: Spark folds the merges of each distinct word, decoding joins the pieces' bytes."""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import Block, word_blocks
from .common import forget_caches, give_back

#: Words with more bytes are merged by a heap: a fold's time grows with the square of a word's length.
LONG_WORD = 64
#: Frequent words that are folded before all others, at most; documents, about, of the sample that they are taken from.
COMMON_WORDS, SAMPLE_DOCS = 160_000, 5_000
#: Words of a block: a few tens of megabytes in the JVM and in a worker.
BLOCK_WORDS = 500_000
#: No merge. Ranks and positions in a folded word are smaller.
_NONE = 1 << 16
#: An id that merges with nothing; it stands before a word.
_START = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank (which is the id) of each piece, from a file with lines of base64 piece and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged) for each way to cut a piece into two pieces."""
    return [(ranks[p[:k]], ranks[p[k:]], r) for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]


class RankMap:
    """The merges as two literal arrays, in which Spark finds a pair in two steps.

    A pair (left, right) has a bucket; a bucket has a shift, and the pair's entry lies at
    left + shift. Pairs of one bucket differ in left, as the bucket's factor is odd and
    ids have 16 bits; shifts are chosen so that no two pairs meet. An entry holds left,
    right and merged id.
    """

    MASK, FACTOR = (1 << 16) - 1, 40503

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) > self.MASK:
            raise ValueError("ids must have 16 bits")
        buckets: dict[int, list[tuple[int, int]]] = {}
        merges = _merges(ranks)
        for left, right, merged in merges:
            buckets.setdefault(left + right * self.FACTOR & self.MASK, []).append((left, left << 32 | right << 16 | merged))
        size = self.MASK + 1 + 2 * len(merges)
        self.shifts, slots = [0] * (self.MASK + 1), [-1] * (2 * size)
        first = 0
        for bucket, pairs in sorted(buckets.items(), key=lambda x: -len(x[1])):
            low = min(left for left, _ in pairs)
            while slots[first] >= 0:
                first += 1
            shift = next(at - low for at in range(first, size) if all(slots[left - low + at] < 0 for left, _ in pairs))
            self.shifts[bucket] = shift
            for left, entry in pairs:
                slots[left + shift] = entry
        self.slots = [1 << 50 if x < 0 else x for x in slots[: max((i for i, x in enumerate(slots) if x >= 0), default=0) + 1]]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row (shifts, slots), written from the two literals."""
        array = lambda xs, name: F.from_json(F.lit(json.dumps(xs, separators=(",", ":"))), "array<bigint>").alias(name)
        return cut_lineage(spark.range(1).select(array(self.shifts, "shifts"), array(self.slots, "slots")))


def with_ranks(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds the rank map as constant columns ``_shifts`` and ``_slots``.

    As literals in each place that looks up a pair they would stand in the plan, and in its
    texts that the driver keeps, many times over.
    """
    return df.withColumns({"_shifts": ranks.select("shifts").scalar(), "_slots": ranks.select("slots").scalar()})


def find(left: Column, right: Column) -> Column:
    """The merged id of a pair by the columns of ``with_ranks``, ``_NONE`` if the two don't merge or one is null."""
    bucket = (left + right * RankMap.FACTOR).bitwiseAND(F.lit(RankMap.MASK)).cast("int")
    entry = F.get(F.col("_slots"), (left + F.get(F.col("_shifts"), bucket)).cast("int"))
    return F.least(entry.bitwiseXOR(F.shiftleft(left, 32).bitwiseOR(F.shiftleft(right, 16))), F.lit(_NONE).cast("bigint"))


def fold_merges(word: Column) -> Column:
    """The ids of a word given the ids of its bytes, beside ``with_ranks``: merge the leftmost pair of lowest rank until none merges.

    The state is one number for each id, behind a start mark: the rank with its
    successor, 16 bits of the place in the word, 20 bits of the id. The smallest number
    is the next merge, which looks up the two ranks that it changes.
    """
    id_of = lambda x: x.bitwiseAND(F.lit((1 << 20) - 1))
    low = lambda x: x.bitwiseAND(F.lit((1 << 36) - 1))
    ranked = lambda x, rank: F.shiftleft(rank, 36).bitwiseOR(x)
    named = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def merge(t: Column, best: Column, at: Column) -> Column:
        merged = F.shiftright(best, 36)
        place = low(best) - id_of(best)
        before = named(low(F.get(t, at - 2)), lambda x: ranked(x, find(id_of(x), merged)))
        after = ranked(place + merged, find(merged, id_of(F.get(t, at + 1))))
        return F.concat(F.slice(t, F.lit(1), at - 2), F.array(before, after), F.slice(t, at + 2, F.size(t)))

    def step(t: Column) -> Column:
        next_ = lambda best: named(F.array_position(t, best).cast("int"), lambda at: merge(t, best, at))
        return named(F.array_min(t), lambda best: F.when(best < F.lit(_NONE << 36), next_(best)).otherwise(t))

    marked = F.concat(F.array(F.lit(_START - 1).cast("bigint")), word)
    begin = named(marked, lambda t: F.transform(t, lambda x, i: ranked(F.shiftleft(i.cast("bigint"), 20).bitwiseOR(x), find(x, F.get(t, i + 1)))))
    rounds = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
    folded = F.aggregate(rounds, begin, lambda t, _: step(t))
    return F.transform(F.filter(folded, lambda x, i: i > 0), lambda x: id_of(x).cast("int"))


def merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same for one long word, with a heap of pairs: n log n."""
    right = [*range(1, len(ids)), -1]
    left = [-1, *range(len(ids) - 1)]
    heap = [(pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    alive = [True] * len(ids)
    while heap:
        merged, i, pair = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or (ids[i], ids[j]) != pair:
            continue
        ids[i], alive[j], right[i] = merged, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (ids[a], ids[b]) in pairs:
                heapq.heappush(heap, (pairs[ids[a], ids[b]], a, (ids[a], ids[b])))
    return [x for x, ok in zip(ids, alive) if ok]


def java_pattern(pattern: str) -> str:
    """The pattern for the JVM, where white space is Unicode's only by a flag."""
    return "(?U)" + pattern


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row; ids are little-endian unsigned 32-bit numbers. With ``decoded`` their bytes too.

    Each match of ``pattern`` is merged for itself by ``ranks``, without special tokens. A
    null text counts as empty and gives no ids; repeated rows stay; other columns are not
    read; an empty table gives no rows. Words are folded in Spark expressions: first the most
    frequent ones of a sample, up to ``COMMON_WORDS``, which are then known to every task, and
    all others once for each task (see ``word_blocks``). The sample spares work and changes no
    id; texts are not shuffled. Words over ``LONG_WORD`` bytes are merged by a heap
    before the fold, which then finds nothing to merge. ``docs`` is read twice, and counted.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    first_ids, rank_map = _first_ids(ranks), RankMap(ranks).table(docs.sparkSession)
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words.alias("words"))
    common = _fold_common(slim.select("words"), first_ids, rank_map)
    known_words, known_ids = (common.column(c).combine_chunks() for c in ("word", "ids"))

    def placed(block: Block) -> list:
        """Byte ids of the words that are not common, and the place of each word in the common ones and these."""
        place = pc.index_in(block.words, known_words)
        new = np.asarray(place.is_null())
        at = np.where(new, len(known_words) + np.cumsum(new) - 1, np.asarray(place.fill_null(0)))
        return [first_ids(block.words.filter(pa.array(new))), pa.array(at, pa.int32()), block.before]

    blocks = word_blocks(slim, kind, "words array<array<bigint>>, place array<int>, before bigint", placed, block_words=BLOCK_WORDS, running=True)
    merged = with_ranks(blocks, rank_map).select("doc_ids", "lens", "codes", "place", "before", F.transform("words", fold_merges).alias("words"))
    pieces = pa.array([p for p, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.large_binary())

    def expand(batches):
        forget_caches()
        lists = None
        for b in batches:
            for i in range(b.num_rows):
                codes = np.frombuffer(b.column("codes")[i].as_py(), np.int32)
                new = pa.concat_arrays([known_ids, b.column("words")[i].values]).take(b.column("place")[i].values)
                before = b.column("before")[i].as_py()
                lists = pa.concat_arrays([lists, new]) if before else new
                if len(lists) != before + len(new):
                    raise ValueError("blocks of a task are out of order")
                sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
                taken = lists.take(pa.array(codes)) if len(codes) else lists.slice(0, 0)
                ids = np.asarray(taken.flatten(), dtype="<u4")
                ends = np.concatenate([[0], np.cumsum(sizes[codes])]) if len(codes) else np.zeros(1, np.int64)
                lens = np.asarray(b.column("lens")[i].values, dtype=np.int64)
                at = ends[np.concatenate([[0], np.cumsum(lens)])]
                ids_of = pa.array([ids[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary())
                out = [b.column("doc_ids")[i].values, pa.array(np.diff(at)), ids_of]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(_bytes_of(ids, at, pieces), pa.binary())] if decoded else []), names=names)
        give_back()

    names = ["doc_id", "n_tokens", "ids", "decoded"][: 4 if decoded else 3]
    return merged.mapInArrow(expand, f"doc_id {kind}, n_tokens bigint, ids binary" + (", decoded binary" if decoded else ""))


def _first_ids(ranks: dict[bytes, int]):
    """f(words) -> ids of each word's bytes; long words come merged."""
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    pairs: dict[tuple[int, int], int] = {}

    def first_ids(words: pa.Array) -> pa.Array:
        data = words.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ids, starts = byte_ids[raw], offsets - offsets[0]
        lens = np.diff(starts)
        if (lens > LONG_WORD).any():
            if not pairs:
                pairs.update({(a, b): m for a, b, m in _merges(ranks)})
            lists = [merge_long(ids[s:e].tolist(), pairs) if e - s > LONG_WORD else ids[s:e] for s, e in zip(starts, starts[1:])]
            ids, starts = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))

    return first_ids


def _fold_common(slim: DataFrame, first_ids, rank_map: DataFrame) -> pa.Table:
    """(word, ids) of the most frequent words of about ``SAMPLE_DOCS`` documents, ``COMMON_WORDS`` words of ``LONG_WORD`` bytes at most."""
    sample = slim.sample(min(1.0, SAMPLE_DOCS / max(1, slim.count())), 1).select(F.explode("words").alias("word"))
    short = sample.where(F.octet_length("word") <= LONG_WORD)
    top = short.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)

    def spelled(batches):
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for b in batches:
            words = b.column("word").cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([one(words), one(first_ids(words))], names=["words", "ids"])

    # Many words a row, as each row carries the rank map.
    dealt = cut_lineage(top.select("word").repartition(slim.sparkSession.sparkContext.defaultParallelism))
    packed = with_ranks(dealt.mapInArrow(spelled, "words array<string>, ids array<array<bigint>>"), rank_map)
    found = packed.select("words", F.transform("ids", fold_merges).alias("ids")).toArrow()
    flat_of = lambda name: pa.concat_arrays([*[x.flatten() for x in found.column(name).chunks]]) if len(found) else None
    words, ids = flat_of("words"), flat_of("ids")
    kinds = pa.schema([("word", pa.large_string()), ("ids", pa.list_(pa.int32()))])
    return pa.table({"word": words, "ids": ids}).cast(kinds) if len(found) else kinds.empty_table()


def _bytes_of(ids: np.ndarray, at: np.ndarray, pieces: pa.Array) -> list[bytes]:
    """The joined pieces of each run of ids between the places ``at``."""
    taken = pieces.take(pa.array(ids.astype(np.int64)))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    data = memoryview(taken.buffers()[2] or b"")
    return [bytes(data[ends[s] : ends[e]]) for s, e in zip(at, at[1:])]


def decode(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded) for each row: the bytes of its ids. Null ids give no bytes; an unknown id is an error."""
    kind = encoded.schema[doc_id].dataType.simpleString()
    pieces = pa.array([p for p, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.large_binary())

    def run(batches):
        for b in batches:
            runs = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
            data = _bytes_of(np.concatenate([*runs, np.zeros(0, "<u4")]), at, pieces)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")
