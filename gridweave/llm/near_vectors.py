"""Near-duplicate vectors by Euclidean p-stable hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linkage import connected_components
from ..session import cut_lineage

# Two unit vectors with cosine 0.98 are 0.2 apart. With width 2 one projection puts them
# in one cell with probability 0.92, 24 of them with 0.135, and one of 48 tables does so
# with 0.999; unrelated vectors (1.4 apart) meet in a table with 3e-8.
TABLES, PROJECTIONS, WIDTH = 48, 24, 2.0


def _unit(lists: pa.Array) -> list[np.ndarray | None]:
    """Double unit vectors; None for null, empty, zero or non-finite ones and those with null components."""
    out: list[np.ndarray | None] = []
    for x in lists:
        v = None if not x.is_valid or x.values.null_count else np.asarray(x.values, dtype=np.float64)
        if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        v = v / np.abs(v).max()
        out.append(v / np.sqrt(v @ v))
    return out


def near_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Rows link when labels are equal and not null, lengths agree and the cosine in double
    precision is at least ``threshold``. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing; they are their own component and
    kept. Repeated rows are rows of their own and link with each other. An empty table
    gives no rows; other columns are not read.

    Equal vectors fold into one node with a count first, so a vector that a third of all
    rows share is one node. Quantised random projections file each node in ``tables``
    tables; nodes that share a cell are candidates, and exact cosines decide. Nothing
    is capped. The chance to miss a link is largest at the threshold (below 0.001
    with the given parameters at 0.98).
    """
    id_kind = df.schema[vec_id].dataType.simpleString()

    def clean(batches):
        for b in batches:
            units = [u if w is not None else None for u, w in zip(_unit(b.column("v")), b.column("label").to_pylist())]
            groups = [None if u is None else f"{w}|{len(u)}" for u, w in zip(units, b.column("label").to_pylist())]
            keys = [None if u is None else hashlib.sha256(f"{g}|".encode() + u.tobytes()).hexdigest()[:32] for u, g in zip(units, groups)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"),
                    pa.array(keys, pa.string()),
                    pa.array(groups, pa.string()),
                    pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                ],
                names=["vec_id", "node", "grp", "unit"],
            )

    slim = df.select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    member = cut_lineage(slim.mapInArrow(clean, f"vec_id {id_kind}, node string, grp string, unit binary"))
    nodes = cut_lineage(
        member.where("node IS NOT NULL")
        .groupBy("node", "grp")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    )

    def cells(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed).integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1
        for b in batches:
            units = [np.frombuffer(x, np.float64) for x in b.column("unit").to_pylist()]
            for dim in {len(u) for u in units}:
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
                a, shift = planes[dim]
                at = np.array([i for i, u in enumerate(units) if len(u) == dim])
                q = np.floor((np.stack([units[i] for i in at]) @ a + shift) / width).astype(np.int64)
                h = (q.reshape(len(at), tables, projections) * mix).sum(axis=2)
                many = pa.array(np.repeat(at, tables))
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").take(many), b.column("grp").take(many), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(h.ravel())],
                    names=["node", "grp", "t", "cell"],
                )

    cell = F.xxhash64("grp", "t", "cell").alias("cell")  # groups that share a hash are told apart below
    filed = nodes.select("node", "grp", "unit").mapInArrow(cells, "node string, grp string, t int, cell bigint").select("node", "grp", cell)
    shared = cut_lineage(filed)
    full = shared.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    filled = shared.join(full, "cell", "left_semi")
    a, b = filled.alias("a"), filled.alias("b")
    pairs = a.join(b, F.expr("a.cell = b.cell AND a.node < b.node AND a.grp = b.grp")).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b")
    ).distinct()

    def cosines(batches):
        for b in batches:
            dots = [
                float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64))
                for x, y in zip(b.column("u").to_pylist(), b.column("w").to_pylist())
            ]
            yield b.select(["a", "b"]).append_column("cosine", pa.array(dots, pa.float64()))

    with_u = pairs.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("u")), "a")
    with_both = with_u.join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("w")), "b").select("a", "b", "u", "w")
    links = cut_lineage(with_both.mapInArrow(cosines, "a string, b string, cosine double").where(F.col("cosine") >= threshold))

    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = nodes.select("node", "first", "copies")
    partners = both.join(counts.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    parts = connected_components(links, "a", "b")
    placed = counts.join(partners, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    known = placed.join(names, "component").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    # The rows of one node may be many: they are the left side, which Spark can split.
    out = member.select("vec_id", "node").join(known, "node", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )
