"""Indel similarity of two text columns (insertions and deletions only)."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row at a time."""
    if a == b:
        return len(a)
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = where.get(ch)
        if hit:
            step = row & hit
            row = ((row + step) | (row - step)) & full
    return len(a) - row.bit_count()


#: Pairs of texts computed at a time, and bytes of their rows or of a table of characters' places.
_CELLS, _TABLE_BYTES = 1 << 14, 16 << 20


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """What :func:`_common_subsequence` gives, for every text of ``a`` with every text of ``b``.

    Bit p of a pair's row stands for character p of its text of ``a``, in words of 64; each step
    takes many pairs one character of their text of ``b`` further.
    """
    if not a or not b:
        return np.zeros((len(a), len(b)), np.int64)
    out = np.empty((len(b), len(a)), np.int64)
    first = len(os.path.commonprefix([*a, *b]))  # always part of the longest
    a, b = sorted(enumerate(x[first:] for x in a), key=lambda x: len(x[1])), sorted(enumerate(x[first:] for x in b), key=lambda x: -len(x[1]))
    (at_a, a), (at_b, b) = zip(*a), zip(*b)
    (chars_a, size_a), (chars_b, size_b) = _code_points(a), _code_points(b)
    letters, codes = np.unique(np.concatenate([chars_a, chars_b]), return_inverse=True)
    codes_a, codes_b = codes[: len(chars_a)], codes[len(chars_a) :]
    ends_a, starts_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
    # Texts of b come longest first, so those that still have a character are the first ones.
    live = [int(n) for n in np.searchsorted(-size_b, -np.arange(size_b[0]))]
    hi = len(a)
    while hi:
        words = max(1, -(-int(size_a[hi - 1]) // 64))
        lo = max(0, hi - max(1, min(_CELLS // len(b), _TABLE_BYTES // (8 * words * max(len(b), len(letters))))))
        begin, end = ends_a[lo] - size_a[lo], ends_a[hi - 1]
        row = np.repeat(np.arange(hi - lo), size_a[lo:hi])
        place = np.arange(begin, end) - np.repeat(ends_a[lo:hi] - size_a[lo:hi], size_a[lo:hi])
        masks = np.zeros((words, len(letters), hi - lo), np.uint64)
        np.bitwise_or.at(masks, (place // 64, codes_a[begin:end], row), np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
        state = np.full((words, len(b), hi - lo), ~np.uint64(0))
        hits, sums = np.empty(state.shape[1:], np.uint64), np.empty(state.shape[1:], np.uint64)
        for k, n in enumerate(live):
            now, hit, total, over = codes_b[starts_b[:n] + k], hits[:n], sums[:n], None
            for w in range(words):
                x = state[w, :n]
                np.take(masks[w], now, axis=0, out=hit, mode="clip")
                np.bitwise_and(hit, x, out=hit)
                np.add(x, hit, out=total)
                if words > 1:  # the sum runs on into the next word
                    carry = total < x
                    if over is not None:
                        np.add(total, over, out=total)
                        carry |= total < over
                    over = carry.astype(np.uint64)
                np.subtract(x, hit, out=x)
                np.bitwise_or(x, total, out=x)
        out[:, lo:hi] = np.bitwise_count(~state).sum(axis=0, dtype=np.int64)
        hi = lo
    whole = np.empty((len(a), len(b)), np.int64)
    whole[np.ix_(at_a, at_b)] = out.T
    whole += first
    return whole


def weighted_ratios(a: pa.Array, b: pa.Array, weight: float) -> np.ndarray:
    """:func:`indel_ratio` times ``weight`` of every text of ``a`` with every text of ``b``; 0 where one is missing."""
    a, b = a.dictionary_encode(), b.dictionary_encode()
    x, y = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    total = np.array([len(t) for t in x], np.float64)[:, None] + np.array([len(t) for t in y], np.float64)
    blank = total == 0
    total[blank] = 1
    ratios = (1.0 - (total - common_subsequences(x, y) * 2) / total) * 100.0
    ratios[blank] = 100.0
    ratios *= weight
    for axis, side, n in ((0, a, len(x)), (1, b, len(y))):
        at = side.indices.fill_null(n).to_numpy(zero_copy_only=False)
        if side.indices.null_count:
            ratios = np.concatenate([ratios, np.zeros((1, ratios.shape[1]) if axis == 0 else (ratios.shape[0], 1))], axis)
        if len(at) > n or side.indices.null_count:
            ratios = np.take(ratios, at, axis)
    return ratios


@F.pandas_udf(T.LongType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _common_subsequence(x, y) for x, y in zip(a, b)], dtype="Int64")


def ratio_from_common(common: Column, a: Column, b: Column) -> Column:
    """100 * (1 - indel distance / total length); two blanks are 100 % alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        (F.lit(1.0) - F.try_divide((total - common * 2).cast("double"), total.cast("double"))) * 100.0
    )


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 100 of whole texts of any length."""
    return ratio_from_common(common_subsequence(a, b), a, b)
