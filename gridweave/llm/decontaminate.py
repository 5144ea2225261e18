"""Benchmark decontamination: BM25 retrieval with block-max pruning, then question and answer overlap."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, filter_texts, shingles, sliced, small_batches, texts_of, token_hashes

#: Items of a posting block; BM25's constants; words of a shingle.
BLOCK, K1, B, SHINGLE = 16, 1.2, 0.75, 5
#: A passage retrieves an item from this share of the item's own BM25 score.
THRESHOLD = 0.7
#: Least shares of the question's and the answer's shingles in the passage.
QUESTION, ANSWER = 0.8, 0.8
#: Words from one passage to the next at least; a passage has twice as many.
STRIDE = 64
#: Text bytes that a task searches at a time; each slice goes through all blocks of the index.
SLICE_BYTES = 4 << 20


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; of one sentence alone, the last quarter is the answer."""
    parts = [w for s in re.split(r"[.!?。]+|\n+", text.lower()) if (w := re.findall(r"\w+", s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4) if words else 0
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Inverted index in blocks of items. Impacts are BM25 weights over the item's own score, so a full match scores 1."""

    items: list = field(default_factory=list)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    top: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: For each block: its items, its terms, their impacts (terms x items).
    blocks: list = field(default_factory=list)
    #: For each item: shingles of question and answer, and the words of each of these.
    sides: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    stride: int = STRIDE

    @staticmethod
    def of(rows: list[tuple]) -> Index:
        from xxhash import xxh3_64_intdigest as digest

        rows = sorted((r for r in rows if r[1] and re.search(r"\w", r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
        if not rows:
            return Index()
        words = [[digest(w) for w in re.findall(r"\w+", text.lower())] for _, text in rows]
        df = Counter(t for w in words for t in set(w))
        terms = np.array(sorted(df), np.uint64)
        place = {t: k for k, t in enumerate(terms.tolist())}
        n, mean = len(rows), sum(map(len, words)) / len(rows)
        idf = {t: np.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        impacts = []
        for w in words:
            one = {place[t]: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(one.values())
            impacts.append({t: x / own for t, x in one.items()})
        top, blocks = np.zeros(len(terms)), []
        for s in range(0, n, BLOCK):
            own = sorted({t for x in impacts[s : s + BLOCK] for t in x})
            dense = np.zeros((len(own), min(BLOCK, n - s)))
            at = {t: k for k, t in enumerate(own)}
            for j, x in enumerate(impacts[s : s + BLOCK]):
                for t, v in x.items():
                    dense[at[t], j] = v
            top[own] = np.maximum(top[own], dense.max(axis=1))
            blocks.append((s, np.array(own, np.int64), dense))
        parts = [question_and_answer(text) for _, text in rows]
        sides = [tuple(np.unique(shingles(np.array([digest(w) for w in p], np.uint64), SHINGLE)) for p in both) for both in parts]
        sizes = [tuple(min(SHINGLE, len(p)) for p in both) for both in parts]
        return Index([r[0] for r in rows], terms, top, blocks, sides, sizes, max(STRIDE, max(map(len, words))))

    def passages(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and end word of all passages: any ``stride`` neighbouring words lie in one passage."""
        sizes = np.diff(offsets)
        count = np.where(sizes > 0, np.maximum(1, -(-(sizes - self.stride) // self.stride)), 0)
        text = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        first = offsets[:-1][text] + nth * self.stride
        return text, first, np.minimum(first + 2 * self.stride, offsets[1:][text])

    def search(self, texts: pa.Array, pruned: bool = True) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, first word, score, question share, answer share) of the best passage of each verified text and item.

        The sum of the largest impacts of a passage's distinct words bounds its scores,
        first over the whole index, then for each block; only blocks whose bound reaches
        the threshold are opened and scored. ``pruned=False`` opens all blocks.
        """
        if not self.items or not len(texts):
            return []
        offsets, words = token_hashes(texts)
        if not len(words):
            return []
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        term = np.where(self.terms[at] == words, at, -1)
        text, first, end = self.passages(offsets)
        lens, n = end - first, len(self.terms)
        owner = np.repeat(np.arange(len(text)), lens)
        own = term[np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
        pairs = distinct((owner * n + own)[own >= 0])
        owner, own = pairs // n, pairs % n
        least = THRESHOLD - 1e-9
        if pruned:
            able = (np.bincount(owner, self.top[own], len(text)) >= least)[owner]
            owner, own = owner[able], own[able]
        best: dict[tuple[int, int], tuple] = {}
        row = np.full(n, -1)
        for s, terms, dense in self.blocks:
            row[:] = -1
            row[terms] = np.arange(len(terms))
            r = row[own]
            here = np.flatnonzero(r >= 0)
            if pruned:
                bound = np.bincount(owner[here], dense.max(axis=1)[r[here]], len(text))
                here = here[(bound >= least)[owner[here]]]
            if not len(here):
                continue
            edges = np.flatnonzero(np.concatenate([[True], owner[here][1:] != owner[here][:-1]]))
            scores = np.add.reduceat(dense[r[here]], edges, axis=0)
            for k, j in np.argwhere(scores >= least).tolist():
                p = int(owner[here[edges[k]]])
                self._verify(best, int(text[p]), s + j, int(first[p] - offsets[text[p]]), float(scores[k, j]), words[first[p] : end[p]])
        return [(t, i, v[1], v[0], v[2], v[3]) for (t, i), v in sorted(best.items())]

    def _verify(self, best: dict, text: int, item: int, at: int, score: float, words: np.ndarray) -> None:
        question, answer = self.sides[item]

        def share(part: np.ndarray, size: int) -> float:
            return float(np.isin(part, shingles(words, size)).mean()) if len(part) else 1.0

        q = share(question, self.sizes[item][0])
        if q < QUESTION:
            return
        a = share(answer, self.sizes[item][1])
        if a >= ANSWER:
            key, found = (text, item), (score, at, q, a)
            if key not in best or (found[0], -found[1]) > (best[key][0], -best[key][1]):
                best[key] = found


def build_index(items: DataFrame, item_id: str = "item_id", text: str = "text", max_bytes: int = 64 << 20) -> Index:
    """The index of all items. Its texts must be at most ``max_bytes`` together, as every task gets it.

    A larger test set is an error here, to be searched in parts. Items without a word
    (null, empty) are in no passage. Repeated items stay items of their own.
    """
    slim = items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`").cast("string"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length(slim.columns[1])), F.lit(0)).alias("n")).first()["n"]
    if size > max_bytes:
        raise ValueError(f"{size} bytes of test items; search them in parts of at most {max_bytes}")
    return Index.of([tuple(r) for r in slim.collect()])


def find_leaks(docs: DataFrame, index: Index, items_kind: str = "bigint", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap) for each document and item it holds.

    Every passage of every document is a query. A null or empty text holds nothing;
    repeated rows give repeated results; an empty table gives none. Other columns are
    not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, "text", SLICE_BYTES):
            found = index.search(texts_of(b, "text"))
            if found:
                t, i, at, score, q, a = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(t)), pa.array([index.items[k] for k in i]), pa.array(at, pa.int32()), pa.array(score), pa.array(q), pa.array(a)],
                    names=["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"],
                )

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return slim.mapInArrow(run, f"doc_id {kind}, item_id {items_kind}, passage_start int, score double, question_overlap double, answer_overlap double")


def keep_clean(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """The rows, all columns unchanged, that hold no item."""

    def clean(texts):
        out = np.ones(len(texts), bool)
        out[[f[0] for f in index.search(texts)]] = False
        return out

    return filter_texts(docs, text, lambda: clean, SLICE_BYTES)
