"""SQL functions for users who write SQL instead of DataFrame code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similarity import common_subsequence
from .text import build_prompt, parse_typed, row_to_text

# Fixed texts: SQL bodies that Catalyst inlines.
SQL_FUNCTIONS = {
    "gw_word_count(t STRING) RETURNS INT": "size(filter(split(t, '\\\\s+'), w -> w <> ''))",
    "gw_column_letter(n INT) RETURNS STRING":
        "CASE WHEN n < 26 THEN char(n + 65) WHEN n < 702 THEN concat(char((n - 26) div 26 + 65), char(n % 26 + 65)) "
        "ELSE concat(char((n - 702) div 676 % 26 + 65), char((n - 702) div 26 % 26 + 65), char(n % 26 + 65)) END",
    "gw_first_text(a STRING, b STRING) RETURNS STRING": "coalesce(nullif(a, ''), nullif(b, ''))",
    "gw_resource_id(t STRING) RETURNS STRING": "split_part(t, '/', 2)",
    "gw_email(a STRING, b STRING) RETURNS STRING":
        "coalesce(nullif(regexp_extract(a, '[a-zA-Z0-9._%+\\\\-]+@[a-zA-Z0-9.\\\\-]+\\\\.[a-zA-Z]{2,}', 0), ''), "
        "regexp_extract(b, '[a-zA-Z0-9._%+\\\\-]+@[a-zA-Z0-9.\\\\-]+\\\\.[a-zA-Z]{2,}', 0))",
    "gw_valid_email(t STRING) RETURNS BOOLEAN": "coalesce(t RLIKE '^[^\\\\s@]+@[^\\\\s@]+\\\\.[^\\\\s@]+$', false)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the SQL functions (and ``gw_common_subsequence``); returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("gw_common_subsequence", common_subsequence)
    return [h.split("(")[0] for h in SQL_FUNCTIONS] + ["gw_common_subsequence"]


def enrich_rows(
    df: DataFrame, instruction: str, output_type: str, call: Callable[[pd.Series], pd.Series], cols: list[str] | None = None, out: str = "answer"
) -> DataFrame:
    """Ask ``call`` (a batch of prompts to a batch of replies) about every row.

    ``call`` runs inside the tasks, one Arrow batch at a time; the reply is parsed
    by ``output_type``.
    """
    prompted = df.withColumn("_prompt", build_prompt(instruction, row_to_text(cols or df.columns), output_type))
    schema = prompted.drop("_prompt").schema.add("_reply", "string")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="_prompt").assign(_reply=call(frame["_prompt"]))

    answered = prompted.mapInPandas(ask, schema)
    return answered.select(*df.columns, parse_typed(F.col("_reply"), output_type).alias(out))
