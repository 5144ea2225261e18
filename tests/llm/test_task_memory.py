"""What a Python worker and its executor hold doesn't grow with the rows of a task."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridweave.llm import blocks, common, language, quality


def test_workers_are_handed_a_few_megabytes(spark, monkeypatch):
    def sizes(batches, *_):
        for b in batches:
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array([str(b.nbytes)] * b.num_rows))

    monkeypatch.setattr(common, "sliced", sizes)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    rows = common.filter_texts(docs, "text", lambda: lambda texts: np.ones(len(texts), bool)).collect()
    assert len(rows) == 400 and max(int(r["text"]) for r in rows) < common.BATCH_BYTES + 200_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    words = docs.select("doc_id", F.split("text", " ").alias("words"))
    made = blocks.word_blocks(words, "bigint", "n bigint", lambda block: [pa.scalar(len(block.codes))]).select("n").collect()
    assert sum(r["n"] for r in made) == 400 * 20_001
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.BATCH_BYTES


def test_caches_of_earlier_stages_go():
    common.worker_cache("tokens of another stage", 10)["a"] = (1,)
    language.LanguageModel({"en": b"some words of it"}).classifier()
    assert not sys.__dict__["_gridweave_caches"]


def test_fit_holds_little_beside_its_cells(monkeypatch):
    rng = np.random.default_rng(3)
    lens = rng.integers(0, 900, 4000)
    starts, y = np.concatenate([[0], np.cumsum(lens)]), rng.integers(0, 2, 4000)
    cells = rng.integers(0, quality.CELLS, starts[-1]).astype(np.int32)
    ratios = rng.normal(size=quality.CELLS)
    monkeypatch.setattr(quality, "SCALED", 1 << 14, raising=False)
    monkeypatch.setattr(quality, "dual_coordinate_descent", lambda *_: np.zeros(quality.CELLS + 1))
    plain = [ratios[cells[s:e]] / max(1e-6, np.linalg.norm(ratios[cells[s:e]])) for s, e in zip(starts, starts[1:])]
    assert np.allclose(quality._scaled(starts, cells, ratios), np.concatenate(plain))
    tracemalloc.start()
    quality.fit_arrays(starts, cells, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * cells.nbytes
