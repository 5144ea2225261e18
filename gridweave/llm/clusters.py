"""Centroid clustering over a VA-file: few-bit cells for all vectors, whole vectors only where distance intervals overlap."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path

#: Components are SCALE times the given ones, rounded down. Larger ones have no 64-bit squared distance.
SCALE, LARGEST = 1024, 1 << 27
#: Bits of a cell, 8 at most.
BITS = 8
#: Vectors that a worker works on at a time.
BATCH = 4096
#: One row a cluster and dimension; dimension -1 has the number of vectors.
SUMS = "cluster int, d int, total bigint"


def scaled(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors): the lists of exactly ``dims`` finite components, as integers."""
    lens, off = np.asarray(lists.value_lengths().fill_null(-1)), np.asarray(lists.offsets, dtype=np.int64)
    full = np.flatnonzero(lens == dims)
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is nan here
    rows = values[off[full][:, None] + np.arange(dims)]
    good = np.isfinite(rows).all(axis=1)
    rows = np.floor(rows[good] * SCALE)
    if (np.abs(rows) > LARGEST).any():
        raise ValueError(f"a component is beyond {LARGEST / SCALE:.0f}, so its squared distance may not fit in 64 bits")
    return full[good], rows.astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each vector to each centroid, in whole numbers."""
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Cells:
    """Cells of each dimension: inner edges at stretched normal quantiles of its mean and spread, outer ones at its extremes.

    Quantiles stretched by the root of 3 make the error of a cell's middle least for normal components.
    """

    def __init__(self, n: float, total: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray):
        mean = total / n
        spread = np.sqrt(3 * np.maximum(squares / n - mean * mean, 0.0))
        quantiles = np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])
        self.edges = np.clip(np.floor(mean[:, None] + spread[:, None] * quantiles).astype(np.int64), low[:, None], high[:, None])
        self.low = np.concatenate([low[:, None], self.edges + 1], axis=1)
        self.high = np.concatenate([self.edges, high[:, None]], axis=1)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each component, a byte. Cell k has the numbers over edge k - 1 up to edge k."""
        return np.stack([np.searchsorted(e, vectors[:, d], side="left") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def table(self, centroids: np.ndarray) -> np.ndarray:
        """[dimension][cell] -> least and then largest part of the distance to each centroid, less that to a pivot.

        The pivot, the middle of the centroids, is the same for all, so intervals are in the same order as
        those of the distances, but narrower: their width doesn't grow with a vector's distance.
        """
        pivot = centroids.sum(axis=0) // len(centroids)
        ends = [(edge - centroids[:, :, None]) ** 2 - (edge - pivot[:, None]) ** 2 for edge in (self.low, self.high)]
        return np.concatenate([np.minimum(*ends), np.maximum(*ends)]).transpose(1, 2, 0)


def decided(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The centroid that is nearest whatever the vector in its cells is; -1 where intervals of several overlap."""
    bounds = np.zeros((len(cells), table.shape[2]), np.int64)
    for d in range(cells.shape[1]):
        bounds += table[d][cells[:, d]]
    k = table.shape[2] // 2
    open_ = bounds[:, :k] <= bounds[:, k:].min(axis=1, keepdims=True)
    return np.where(open_.sum(axis=1) == 1, open_.argmax(axis=1), -1)


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _parts(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def _sums(batches, k: int, dims: int, moves: Callable) -> Iterator[pa.RecordBatch]:
    """One batch a task: number and sum of the vectors that come to each cluster, less those that leave it."""
    n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for part in _parts(batches):
        v = _unpacked(part.column("vector"), dims)
        copies = np.asarray(part.column("copies"))
        weighted = v * copies[:, None]
        for place, sign in moves(part, v):
            for c in range(k):
                mine = place == c
                n[c] += sign * copies[mine].sum()
                total[c] += sign * weighted[mine].sum(axis=0)
    rows = np.concatenate([n[:, None], total], axis=1)
    cluster, d = np.repeat(np.arange(k, dtype=np.int32), dims + 1), np.tile(np.arange(-1, dims, dtype=np.int32), k)
    yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(d), pa.array(rows.ravel())], names=["cluster", "d", "total"])


class VectorFile:
    """Distinct vectors with their numbers of copies, in a table bucketed by key, and their cells in another."""

    def __init__(self, whole: DataFrame, path: str, dims: int):
        self.spark, self.dims, self.name = whole.sparkSession, dims, f"gridweave_vectors_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        one = F.assert_true(F.min("vector") == F.max("vector"), F.lit("two vectors have one key"))
        folded = whole.groupBy(F.md5("vector").alias("key")).agg(F.min("vector").alias("vector"), F.count("*").alias("copies"), one.alias("checked"))
        table = folded.where("checked IS NULL").select("key", "vector", "copies")
        table.write.bucketBy(buckets, "key").sortBy("key").option("path", f"{path}/vectors").saveAsTable(self.name)
        self.vectors = self.spark.table(self.name)
        self.cells = self._edges()
        cells = self.cells

        def pack(batches):
            for part in _parts(batches):
                packed = pa.array([x.tobytes() for x in cells.of(_unpacked(part.column("vector"), dims))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), packed, part.column("copies")], names=["key", "packed", "copies"])

        self.vectors.mapInArrow(pack, "key string, packed binary, copies bigint").write.parquet(f"{path}/cells")
        self.packed = self.spark.read.schema("key string, packed binary, copies bigint").parquet(f"{path}/cells")

    def close(self) -> None:
        """Takes the table from the catalog; its files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _edges(self) -> Cells:
        """From the mean, spread and extremes of all vectors: one row a dimension comes to the driver."""
        dims = self.dims

        def moments(batches):
            n, total, squares = 0, np.zeros(dims), np.zeros(dims)
            low, high = np.full(dims, LARGEST, np.int64), np.full(dims, -LARGEST, np.int64)
            for part in _parts(batches):
                v, copies = _unpacked(part.column("vector"), dims), np.asarray(part.column("copies"), dtype=float)
                n, total, squares = n + copies.sum(), total + copies @ v, squares + copies @ (v.astype(float) ** 2)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
            columns = pa.array(range(dims), pa.int32()), pa.array([float(n)] * dims), pa.array(total), pa.array(squares), pa.array(low), pa.array(high)
            yield pa.RecordBatch.from_arrays(list(columns), names=["d", "n", "s", "q", "lo", "hi"])

        stats = self.vectors.select("vector", "copies").mapInArrow(moments, "d int, n double, s double, q double, lo bigint, hi bigint")
        rows = stats.groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("lo"), F.max("hi")).orderBy("d").collect()
        _, n, total, squares, low, high = (np.array(x) for x in zip(*rows))
        return Cells(n[0], total, squares, low.astype(np.int64), high.astype(np.int64))

    def first_sums(self, means: np.ndarray) -> DataFrame:
        """The sums of all vectors, each in its nearest cluster."""
        k, dims = len(means), self.dims
        nearest = lambda _, v: [(distances(v, means).argmin(axis=1), 1)]
        return self.vectors.select("vector", "copies").mapInArrow(lambda bs: _sums(bs, k, dims, nearest), SUMS)

    def fetched(self, before: np.ndarray, after: np.ndarray) -> DataFrame:
        """(key, copies, old, new) of the vectors that may have moved; -1 where cells can't tell the cluster."""
        cells = self.cells

        def pick(batches):
            old_table, new_table = cells.table(before), cells.table(after)
            for part in _parts(batches):
                packed = np.frombuffer(b"".join(part.column("packed").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                old, new = decided(packed, old_table), decided(packed, new_table)
                take = pa.array(np.flatnonzero((old < 0) | (new < 0) | (old != new)))
                columns = part.column("key"), part.column("copies"), pa.array(old, pa.int32()), pa.array(new, pa.int32())
                yield pa.RecordBatch.from_arrays([c.take(take) for c in columns], names=["key", "copies", "old", "new"])

        return self.packed.mapInArrow(pick, "key string, copies bigint, old int, new int")

    def moved_sums(self, before: np.ndarray, after: np.ndarray) -> DataFrame:
        """What changes in the sums when the centroids were ``before`` and are ``after``."""
        k, dims = len(after), self.dims

        def moves(part, v):
            for name, means, sign in (("old", before, -1), ("new", after, 1)):
                place = np.array(part.column(name))
                unsure = np.flatnonzero(place < 0)
                place[unsure] = distances(v[unsure], means).argmin(axis=1)
                yield place, sign

        joined = self.fetched(before, after).join(self.vectors.select("key", "vector"), "key")
        return joined.select("copies", "old", "new", "vector").mapInArrow(lambda bs: _sums(bs, k, dims, moves), SUMS)


def cluster(df: DataFrame, centroids: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept row, the final centroids).

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a component x
    becomes floor(1024 x). Centroids start as the kept vectors with the smallest SHA-256
    of ``<seed>:<id>`` (equal ids: by components; null ids last), fewer if fewer are kept.
    A round assigns each vector to the nearest (ties: the smaller number) and moves each
    centroid to its vectors' floored mean; an empty one stays. Then vectors are assigned
    once more. Repeated rows count each; an empty table gives no rows; other columns
    are not read. A component beyond 131,072 stops the job.

    Equal vectors fold into one with a number of copies. The first round and the last
    assignment need every vector. Between them a round reads cells of 8 bits a dimension, a
    quarter of a vector: look-up tables give the interval of distances to each centroid before and
    after its last move, and only vectors that may have changed their cluster (intervals
    overlap, or the clusters differ) are fetched, compared exactly and added to or
    taken from the sums. The vectors lie in buckets by key, so only keys are shuffled for it.
    What comes to the driver is sums, one row a centroid.
    """
    spark, kind, path = df.sparkSession, df.schema[vec_id].dataType.simpleString(), work_path(df.sparkSession, "clusters")

    def keep(batches):
        for b in batches:
            at, rows = scaled(b.column("v"), dims)
            data = [r.tobytes() for r in rows.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(data, pa.binary())], names=["vec_id", "vector"])

    slim = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    slim.mapInArrow(keep, f"vec_id {kind}, vector binary").write.parquet(f"{path}/whole")
    whole = spark.read.schema(f"vec_id {kind}, vector binary").parquet(f"{path}/whole")

    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = whole.orderBy(first.asc_nulls_last(), "vector").limit(centroids).collect()
    means, k = np.array([np.frombuffer(r["vector"], "<i4") for r in start], np.int64).reshape(-1, dims), len(start)
    if k and rounds:
        file = VectorFile(whole, path, dims)
        sums, before = np.zeros((k, dims + 1), np.int64), None
        for _ in range(rounds):
            changes = file.first_sums(means) if before is None else file.moved_sums(before, means)
            for r in changes.groupBy("cluster", "d").agg(F.sum("total")).collect():
                sums[r[0], r[1] + 1] += r[2]
            n, total = sums[:, :1], sums[:, 1:]
            before, means = means, np.where(n > 0, total // np.maximum(n, 1), means)
        file.close()
    final = means

    def assigned(batches):
        for part in _parts(batches):
            d = distances(_unpacked(part.column("vector"), dims), final)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "cluster", "distance"])

    return whole.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance bigint"), final
