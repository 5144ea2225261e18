"""From raw documents to token ids: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import byte_bpe, decontaminate, language, near_text, quality, queries
from gridweave.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep(docs, queries.quality_model(spark, docs, sf_dir))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language stays unsure."""
    return language.keep(docs, queries.language_model(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return near_text.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, decontaminate.build_index(items))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): byte-level BPE ids, and the digest of the bytes they decode to."""
    ranks = byte_bpe.load_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    done = byte_bpe.encode(docs, ranks, queries.tokenizer_pattern(), decoded=True)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_text", one_of_each),
    ("decontaminate", without_benchmark),
    ("byte_bpe", token_ids),
]

#: SQL can't express the stages. The tests check ids and decoded texts of the whole run only, and no stage's kept rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
