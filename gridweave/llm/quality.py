"""Quality classifier: a linear hinge-loss model over n-grams scaled by class log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import distinct, filter_texts, flat, give_back, map_texts, sliced, small_batches, texts_of, token_hashes

#: Cells of the hashed n-grams.
CELLS = 1 << 16
#: Most labelled rows that the model is fitted on.
FIT_ROWS = 16_384
#: Cells, about, whose values are scaled at a time.
SCALED = 1 << 20
#: Documents with a lower score are rejected.
KEEP_FROM = 0.3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of each text's 1- and 2-grams of words and runs of marks: start of each text, and the cells.

    A word that follows itself has one cell whatever the word.
    """
    offsets, h = token_hashes(texts, r"\w+|[^\w\s]+", lower=False)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    two = np.where(h[:-1] == h[1:], np.uint64(1), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    two, two_owner = two[(same := owner[:-1] == owner[1:])], owner[:-1][same]
    cells = np.concatenate([h, two ^ (two >> np.uint64(29))]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)
    keys = distinct(np.concatenate([owner, two_owner]) * CELLS + cells.astype(np.int64) % CELLS)
    return np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) * CELLS), (keys % CELLS).astype(np.int32)


def log_count_ratios(starts: np.ndarray, cells: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each cell in class 1 against class 0."""
    each = np.repeat(y > 0, np.diff(starts))
    p = alpha + np.bincount(cells[each], minlength=CELLS)
    q = alpha + np.bincount(cells[~each], minlength=CELLS)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _scaled(starts, cells, ratios):
    """Values of each row, of length 1 in all; some rows at a time, so that little stands beside the result."""
    values, lens = ratios[cells], np.diff(starts)
    edges = [0, *(np.flatnonzero(np.diff(starts[:-1] // SCALED)) + 1).tolist(), len(lens)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            v = values[starts[a] : starts[b]]
            sums = np.add.reduceat(np.append(v * v, 0.0), starts[a:b] - starts[a]) * (lens[a:b] > 0)
            v /= np.repeat(np.sqrt(np.maximum(sums, 1e-12)), lens[a:b])
    return values


def dual_coordinate_descent(
    starts: np.ndarray, cells: np.ndarray, values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, tol: float = 0.01, seed: int = 0
) -> np.ndarray:
    """Weights (bias last) of the L1-loss linear SVM, each dual variable between 0 and its row's cost."""
    w, a, rng = np.zeros(CELLS + 1), np.zeros(len(y)), np.random.default_rng(seed)
    rows = [(cells[s:e], values[s:e]) for s, e in zip(starts[:-1], starts[1:])]
    q = np.array([v @ v + 1.0 for _, v in rows])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            c, v = rows[i]
            g = y[i] * (w[c] @ v + w[-1]) - 1.0
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if (d := new - a[i]) != 0.0:
                a[i] = new
                w[c] += d * y[i] * v
                w[-1] += d * y[i]
                worst = max(worst, abs(d) * q[i])
        if worst < tol:
            break
    return w


def _sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to P(label 1), by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([m, np.ones_like(m)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - t) + 1e-3 * (b - [1.0, 0.0]))
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


@dataclass
class QualityModel:
    """Score = logistic(slope * margin + shift); the margin of a text is the mean of its cells' ratios times weights."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def margins(self, starts: np.ndarray, cells: np.ndarray) -> np.ndarray:
        products = _scaled(starts, cells, self.ratios) * self.weights[cells]
        return np.diff(np.concatenate([[0.0], np.cumsum(products)])[starts]) + self.weights[-1]

    def scores(self, texts: pa.Array) -> np.ndarray:
        m = self.margins(*features(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def fit_arrays(starts: np.ndarray, cells: np.ndarray, y: np.ndarray) -> QualityModel:
    """Fit on 4 of 5 rows, calibrate on the fifth. With one class only, every score is its smoothed share."""
    y = np.where(y > 0, 1.0, -1.0)
    if len(y) < 10 or abs(y.sum()) > len(y) - 4:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(CELLS), np.zeros(CELLS + 1), 1.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(starts, cells, y)
    last = np.zeros(len(y), bool)
    for side in (1.0, -1.0):
        last[np.flatnonzero(y == side)[::5]] = True

    def part(rows):
        lens = np.diff(starts)
        return np.concatenate([[0], np.cumsum(lens[rows])]), cells[np.repeat(rows, lens)]

    first, rest = np.flatnonzero(~last), np.flatnonzero(last)
    s, c = part(~last)
    v = _scaled(s, c, ratios)
    cost = np.where(y[first] > 0, 0.5 * len(first) / (y[first] > 0).sum(), 0.5 * len(first) / (y[first] < 0).sum())
    model = QualityModel(ratios, dual_coordinate_descent(s, c, v, y[first], cost), 1.0, 0.0)
    del v
    s, c = part(last)
    model.slope, model.shift = _sigmoid_fit(model.margins(s, c), y[rest])
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """The model of at most ``fit_rows`` labelled documents, those whose ids have the smallest hashes.

    Rows of ``labels`` with a null id or quality are left out; several labels of one id
    count by their largest. The sample of labels is bounded by ``fit_rows`` and so is
    its broadcast; the documents themselves don't move before they are hashed to cells.
    One task fits the sample, which is the same at any size of the corpus.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cells(batches):
        for b in sliced(batches, "text"):
            starts, c = features(texts_of(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(c))], names=["y", "cells"])

    small_batches(docs.sparkSession)
    # Repeated rows of an id count once for each row; the limit bounds them too.
    joined = texts.join(F.broadcast(sample), "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    hashed = cut_lineage(joined.mapInArrow(cells, "y int, cells array<int>"))

    def train(batches):
        ys, lens, all_cells = [], [], []
        for b in batches:
            o, c = flat(b.column("cells"))
            ys.append(np.asarray(b.column("y")))
            lens.append(np.diff(o))
            all_cells.append(np.asarray(c, dtype=np.int32))
        join = lambda xs, kind: np.concatenate(xs).astype(kind, copy=False) if xs else np.zeros(0, kind)
        cells_of_all = join(all_cells, np.int32)
        all_cells.clear()
        m = fit_arrays(np.concatenate([[0], np.cumsum(join(lens, np.int64))]), cells_of_all, join(ys, np.int64))
        del cells_of_all
        give_back()
        yield pa.RecordBatch.from_pydict({"ratios": [m.ratios.tolist()], "weights": [m.weights.tolist()], "slope": [m.slope], "shift": [m.shift]})

    ordered = hashed.orderBy(F.xxhash64("cells"), "y").limit(fit_rows)
    rows = ordered.coalesce(1).mapInArrow(train, "ratios array<double>, weights array<double>, slope double, shift double").collect()
    r = rows[0] if rows else None
    return fit_arrays(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0)) if r is None else QualityModel(np.array(r["ratios"]), np.array(r["weights"]), r["slope"], r["shift"])


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row; null and empty texts get the score of a text without words. Other columns are not read."""
    return map_texts(docs, doc_id, text, "score double", lambda: lambda t: [pa.array(model.scores(t))])


def keep(docs: DataFrame, model: QualityModel, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows, all columns unchanged, whose score is at least ``keep_from``."""
    return filter_texts(docs, text, lambda: lambda t: model.scores(t) >= keep_from)
