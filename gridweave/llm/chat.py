"""Conversations as one training text each, with a loss mask, in Spark expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings of the format. ``reserved`` are those of other formats, escaped too.

    None of them may hold a backslash or have one character only.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    more: str = "<|next|>"
    end: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.more, self.end, *self.reserved)


def escape(text: Column, template: Template = Template()) -> Column:
    """Text without control strings: backslashes doubled, and one put behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def running_totals(values: Column, chunk: int = 1024) -> Column:
    """For each number of an array, the sum of those before it.

    Two levels of folds: an append copies its array, so one fold over n numbers
    would copy n * n / 2 of them; this copies n * chunk / 2.
    """
    sums = lambda xs: F.aggregate(
        xs,
        F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")),
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest((F.size(values) - 1) / chunk, F.lit(0)).cast("int")),
        lambda c: sums(F.slice(values, c * chunk + 1, F.lit(chunk))),
    )
    bases = lambda ps: F.aggregate(
        ps,
        F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("a")),
        lambda acc, p: F.struct(
            (acc["s"] + p["s"]).alias("s"), F.array_append(acc["a"], F.transform(p["a"], lambda x: x + acc["s"])).alias("a")
        ),
    )
    return F.flatten(bases(parts)["a"])


def format_conversations(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: tuple[str, ...] = ("assistant",),
    template: Template = Template(),
) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation.

    Turns come in the order of turn, role, text (null turn first; repeated rows stay,
    as turns of their own). A null role or text counts as empty; rows with a null
    conversation id form one conversation. Neighbours of one role become one block,
    their texts parted by ``template.more``, so each row can be read back. Loss spans
    are (start, length) in code points, one for each text of a trained role. Other
    columns of ``rows`` are not read; an empty table gives no rows.

    A conversation is one output row, so it must fit in a row (2 GB); the folds over
    its turns take time in proportion to their number.
    """
    t, chars = template, lambda s: F.lit(len(s))
    slim = rows.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("m"),
    )
    turns = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("t"))
    first = turns.withColumn(
        "first",
        F.filter(
            F.sequence(F.lit(1), F.size("t")),
            lambda i: (i == 1) | (F.get(F.col("t"), i - 1)["role"] != F.get(F.col("t"), i - 2)["role"]),
        ),
    )
    blocks = first.select(
        "conv_id",
        F.transform(
            "first",
            lambda s, j: F.struct(
                F.get(F.col("t"), s - 1)["role"].isin(*trained).alias("trained"),
                escape(F.get(F.col("t"), s - 1)["role"], t).alias("role"),
                F.transform(
                    F.slice("t", s, F.coalesce(F.get(F.col("first"), j + 1), F.size("t") + 1) - s), lambda x: escape(x["text"], t)
                ).alias("texts"),
            ),
        ).alias("blocks"),
    )
    pieces = blocks.select(
        "conv_id",
        F.array_join(
            F.transform(
                "blocks",
                lambda b: F.concat(F.lit(t.turn), b["role"], F.lit(t.body), F.array_join(b["texts"], t.more), F.lit(t.end)),
            ),
            "",
        ).alias("formatted"),
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    b["texts"],
                    lambda x, i: F.struct(
                        F.when(i == 0, chars(t.turn + t.body) + F.length(b["role"])).otherwise(chars(t.more)).alias("before"),
                        F.length(x).alias("length"),
                        F.when(i == F.size(b["texts"]) - 1, chars(t.end)).otherwise(0).alias("after"),
                        b["trained"].alias("trained"),
                    ),
                ),
            )
        ).alias("items"),
    )
    placed = pieces.withColumn("at", running_totals(F.transform("items", lambda x: x["before"] + x["length"] + x["after"])))
    spans = F.filter(
        F.zip_with(
            "items",
            "at",
            lambda x, a: F.struct(
                (a + x["before"]).cast("int").alias("start"), x["length"].alias("length"), x["trained"].alias("trained")
            ),
        ),
        lambda s: s["trained"],
    )
    return placed.select(
        "conv_id", "formatted", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans")
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array of (role, text), one for each original row."""
    quote = lambda s: rf"\Q{s}\E"
    blocks = F.filter(F.split(formatted, quote(template.end), -1), lambda b: b != "")

    def texts(b: Column) -> Column:
        halves = F.split(b, quote(template.body), 2)
        role = unescape(F.substr(F.get(halves, F.lit(0)), F.lit(len(template.turn) + 1)))
        return F.transform(
            F.split(F.get(halves, F.lit(1)), quote(template.more), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, texts))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The original texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
