"""Blocks of documents whose words are coded by a dictionary of the block."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import flat, forget_caches, give_back, small_batches

#: Words of a block at most; a longer document is a block alone.
BLOCK_WORDS = 4_000_000
#: Distinct words that a running dictionary holds before it starts anew.
HELD_WORDS = 1_000_000


@dataclass
class Block:
    """Documents of one task, in order; ``codes`` are places in ``words``, which follow ``before`` words of earlier blocks."""

    number: int
    doc_ids: pa.Array
    lens: np.ndarray
    codes: np.ndarray
    words: pa.Array
    extra: dict[str, pa.Array]
    before: int = 0


def word_blocks(docs: DataFrame, id_kind: str, extra_schema: str, extra: Callable[[Block], list[pa.Array]], carried: tuple[str, ...] = (), block_words: int = BLOCK_WORDS, running: bool = False) -> DataFrame:
    """(block, doc_ids, lens, codes, <extra>) of (doc_id, words array<string>, <carried>).

    A block has the documents of one task up to ``block_words`` words. ``codes`` are
    32-bit places in the block's dictionary of distinct words; ``extra(block)`` gives the
    one value of each further column. So work on words is done once for each distinct
    one of a block, words don't have to be shuffled one by one, and documents are put
    together again by two look-ups. Blocks are numbered by task, so a task that runs
    again makes the same ones.

    With ``running`` a word stands only in the first block of its task that has it, so
    blocks can be small: ``codes`` are places in the words of all the task's blocks, of
    which a block brings those after ``before``. A ``before`` of 0 starts anew, which
    happens after ``HELD_WORDS`` distinct words.
    """
    names = [x.strip().split(" ")[0] for x in extra_schema.split(", ")]

    def run(batches):
        forget_caches()
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        seen = None

        def flush():
            nonlocal held, made, seen
            parts, held = held, []
            past = [] if seen is None else [pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), seen)]
            coded = pa.chunked_array([*past, *[p[2] for p in parts]]).unify_dictionaries()
            words, before = coded.chunk(0).dictionary, len(past and seen)
            seen = words if running and len(words) < HELD_WORDS else None
            block = Block(
                (task << 24) + made,
                pa.concat_arrays([p[0] for p in parts]),
                np.concatenate([p[1] for p in parts]),
                np.concatenate([np.asarray(c.indices, dtype=np.int32) for c in coded.chunks]),
                words.slice(before).cast(pa.large_string()),
                {n: pa.concat_arrays([p[3][n] for p in parts]) for n in carried},
                before,
            )
            made += 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([block.number], pa.int64()), one(block.doc_ids), one(pa.array(block.lens, pa.int32())), pa.array([block.codes.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *[one(x) if isinstance(x, pa.Array) else pa.array([x]) for x in extra(block)]], names=["block", "doc_ids", "lens", "codes", *names])

        total = 0
        for b in batches:
            at = 0
            offsets, words = flat(b.column("words"))
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_words - total, side="right")) - 1)
                end = min(end, b.num_rows)
                s, n = offsets[at], offsets[end] - offsets[at]
                coded = pc.dictionary_encode(words.slice(s, n))
                held.append((b.column("doc_id").slice(at, end - at), np.diff(offsets[at : end + 1]).astype(np.int32), coded, {c: b.column(c).slice(at, end - at) for c in carried}))
                total += n
                at = end
                if total >= block_words:
                    yield flush()
                    total = 0
        if held:
            yield flush()
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"block bigint, doc_ids array<{id_kind}>, lens array<int>, codes binary, {extra_schema}")
