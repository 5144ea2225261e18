"""Changed cells: batch comparison of two versions and a stateful stream form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Fixed value: keys that a task combines before it sends them to the state.
_HELD = 20_000


def changed_cells(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row per cell whose value differs between two versions (unique keys)."""
    a = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    b = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_o_{c}").cast("string").alias("old"), F.col(f"_n_{c}").cast("string").alias("new")) for c in cols]
    )
    differing = F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return b.join(a, keys).select(*keys, F.explode(differing).alias("_c")).select(*keys, "_c.column", "_c.old", "_c.new")


def _latest(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.loc[frame.groupby("key")["seq"].idxmax()]


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Newest row per key over a task's Arrow batches; what is held goes on when it reaches ``_HELD`` rows."""
    held = None
    for frame in frames:
        if len(frame):
            held = _latest(frame if held is None else pd.concat([held, frame], ignore_index=True))
            if len(held) >= _HELD:
                yield held
                held = None
    if held is not None:
        yield held


class _LastCell(StatefulProcessor):
    """Remembers the newest value per key and emits when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        newest = None
        for frame in rows:
            row = frame.loc[frame["seq"].idxmax()]
            if newest is None or row["seq"] > newest[1]:
                newest = (row["value"], int(row["seq"]))
        out = []
        if newest is not None and (known is None or newest[1] > known[1]):
            if known is not None and known[0] != newest[0]:
                out.append((key[0], known[0], *newest))
            self.last.update(newest)
        yield pd.DataFrame(out, columns=["key", "old", "new", "seq"])

    def close(self) -> None:
        pass


def cell_changes(edits: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Stream of (key, old, new, seq): cells whose value after a micro-batch differs
    from the one before it. State is one value per cell; the order of rows within a
    batch does not matter, rows older than the known one are ignored. Rows with a null
    key are one cell of their own, rows with a null ``seq`` have no place in the order and
    are ignored.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to :data:`ROCKSDB`.
    """
    # Keys go to Python as texts that are never null: "=" and the key, or "" for a null one.
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    shaped = edits.select(named.alias("key"), F.col(value).cast("string").alias("value"), F.col(seq).cast("bigint").alias("seq"))
    shaped = shaped.where("seq IS NOT NULL")
    newest = shaped.mapInPandas(_combine, shaped.schema)
    changes = newest.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_LastCell(), outputStructType="key string, old string, new string, seq bigint",
        outputMode="Append", timeMode="None",
    )
    return changes.withColumn("key", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
