"""What the operators share: folds, text batches, word blocks."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker works on at a time.
SLICE_BYTES = 1 << 20
#: Pieces that a worker keeps hashed, and the longest one of them.
CACHED_PIECES, CACHED_CHARS = 150_000, 100
#: Bytes of rows that Spark hands a Python worker at a time. Its own 64 MB stand in the JVM and in the worker of each task.
BATCH_BYTES = 8 << 20


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Actions within hand Python workers at most ``rows`` rows at a time; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers about ``BATCH_BYTES`` at a time; a row is never cut.

    It stays set, as Spark reads it when the result of an operator is asked for, which is after the
    operator has returned. Rows are the same either way.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Hands free memory of the worker back to the machine; workers live on after a task."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def in_fold(doc_id: Column, folds: int, one: int) -> Column:
    """True where the id falls in fold ``one``; a null id counts as held out, so nothing is learned from it."""
    return F.coalesce(fold(doc_id, folds) == one, F.lit(True))


def worker_cache(name: str, limit: int) -> dict:
    """A dict that outlives the task, so the stage's next one in the same Python worker finds it filled.

    It starts anew when it holds ``limit`` entries, and a worker keeps one cache alone: that of
    an earlier stage goes when another one is asked for. Only pure functions of the key may
    be kept in it.
    """
    caches = sys.__dict__.setdefault("_gridweave_caches", {})
    for other in [n for n in caches if n != name]:
        del caches[other]
    cache = caches.setdefault(name, {})
    if len(cache) >= limit:
        cache.clear()
    return cache


def forget_caches() -> None:
    """For a task that keeps no ``worker_cache``: those of earlier stages go."""
    sys.__dict__.get("_gridweave_caches", {}).clear()


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with null as the empty text."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def sliced(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer text is a batch alone. At the end free memory goes back."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        piece = np.cumsum(sizes) // size
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def map_texts(df: DataFrame, doc_id: str, text: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """(doc_id, <schema>) for each row. ``make()`` runs once a task and gives f(texts) -> list of arrays."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        f = make()
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *f(texts_of(b, "text"))], names=["doc_id", *names])

    small_batches(df.sparkSession)
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = f"doc_id {kind}, {schema}"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return slim.mapInArrow(run, out)


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable], size: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns as they are, where f(texts) of ``make()`` is true; ``size`` bytes of text at a time."""

    def run(batches):
        f = make()
        for b in sliced(batches, text, size):
            yield b.filter(pa.array(np.asarray(f(texts_of(b, text)), dtype=bool)))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Start of each list (one more at the end) and the values, both counted from 0."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def chunk_codes(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Each text cut at ASCII white space: start of each text, and its pieces by a dictionary of the distinct ones."""
    for space in "\n\t\r\x0b\x0c":
        texts = pc.replace_substring(texts, space, " ")
    offsets, pieces = flat(pc.split_pattern(texts, " "))
    return offsets, pc.dictionary_encode(pieces)


def strings(texts: pa.Array) -> list[str]:
    """Texts without line ends as Python strings: one join and one split."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if len(texts) else []


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each text cut at ASCII white space: start of each text, code of each piece, and the distinct pieces.

    Dear work on pieces is then done once for each distinct one.
    """
    offsets, coded = chunk_codes(texts)
    return offsets, np.asarray(coded.indices, dtype=np.int64), strings(coded.dictionary)


def spread_lists(offsets: np.ndarray, codes: np.ndarray, lists: list, kind) -> tuple[np.ndarray, np.ndarray]:
    """The lists of all pieces in order: start of each text, and the values."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter(chain.from_iterable(lists), kind, int(lens.sum()))
    return spread(offsets, codes, np.concatenate([[0], np.cumsum(lens)]), values)


def spread(offsets: np.ndarray, codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for lists that lie one after another in ``values``, from ``starts``."""
    taken = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(values)).take(pa.array(codes))
    at = np.concatenate([[0], np.cumsum(np.diff(starts)[codes])])
    _, out = flat(taken)
    return at[offsets], np.asarray(out, dtype=values.dtype)


def token_hashes(texts: pa.Array, pattern: str = r"\w+", lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens that ``pattern`` finds between white space: start of each text, and the hashes."""
    from xxhash import xxh3_64_intdigest

    offsets, codes, pieces = chunks_of(pc.utf8_lower(texts) if lower else texts)
    known, find = worker_cache(f"tokens {pattern} {lower}", CACHED_PIECES), re.compile(pattern).findall
    lists = []
    for p in pieces:
        got = known.get(p)
        if got is None:
            got = tuple(map(xxh3_64_intdigest, find(p)))
            if len(p) <= CACHED_CHARS and len(known) < CACHED_PIECES:
                known[p] = got
        lists.append(got)
    return spread_lists(offsets, codes, lists, np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; by sorting, which beats hashing for millions of them."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words; of all words if there are fewer, none without words."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return out
