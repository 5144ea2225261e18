"""Session helpers: shared folders, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a fresh
    temporary folder. A cluster without it is an error, because a folder on one
    machine is lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="gridweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never used twice.

    All paths of one application share a parent, which can go when it has ended.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/gridweave-{app}/{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    A lost executor then replays nothing from before. A written table beats a
    checkpointed RDD here: later steps read only the columns they need, and its true
    size lets Spark choose the joins.
    """
    path = work_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 32 << 20) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Reads no more than ``max_rows + 1`` rows, so the check is cheap on any input.
    """
    size = F.length(F.to_json(F.struct("*")))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise leave the join to AQE."""
    return F.broadcast(df) if is_small(df, **bounds) else df


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when the input has fewer splits than cores.

    One small file is one split however costly its rows are. A large input has
    splits enough and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_rows(df: DataFrame, keys: list[str], rows: int = 500_000) -> DataFrame:
    """Deal the rows by ``keys`` to tasks of about ``rows`` rows each.

    Spark merges shuffled parts by their compressed bytes, so rows that repeat would all
    go to one task, whose memory then grows with the input.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def by_bytes(df: DataFrame, text: str, size: int = 8 << 20) -> DataFrame:
    """Deal the rows evenly to tasks of about ``size`` bytes of ``text`` each; reads that column once more."""
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // size)))
