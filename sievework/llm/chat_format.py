"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn, then role, then text. Adjacent
turns of one role are merged into a block; a conversation's formatted text is

    <s>[INST]role[/INST]text[TURN]text</s><s>[INST]role[/INST]text</s>

In roles and texts every control string gets a backslash after its first character, and one more where it
has some already, so that none stands in a text and the escape is undone exactly. The loss mask is a list
of code point spans of the formatted text, one for each assistant text.

Null texts and roles are empty strings; very long texts are formatted whole. Turns of equal number are ordered by
role and text; repeated rows stay. A null conversation id is a conversation of its own. Other columns of the input are
not read, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import prefix_sums

BEGIN, END, HEAD, BODY, NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[TURN]"
_TAIL = r"(/?s>|/?INST\]|TURN\])"
ESCAPED = r"([<\[])(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learner: str = "assistant"
) -> DataFrame:
    """One row per conversation: its id, formatted (string), loss_mask (array of start and end)."""
    clean = rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), escape(F.coalesce(F.col(f"`{role}`"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text")
        ).alias("t"),
    )
    turns = clean.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # a block starts where the role differs from that of the turn before
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"])
    )
    runs = turns.withColumn("starts", starts)
    block = lambda b, k: F.struct(
        F.get(F.col("turns"), b)["role"].alias("role"),
        F.transform(
            F.slice(F.col("turns"), b + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns")) - b),
            lambda t: t["text"]
        ).alias("texts"),
    )
    blocks = runs.select("conv", F.transform("starts", block).alias("blocks"))
    written = lambda b: F.concat(F.lit(BEGIN + HEAD), b["role"], F.lit(BODY), F.array_join(b["texts"], NEXT), F.lit(END))
    # lengths of what stands before each text, and of the text with it
    lead = lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        (F.length(t)).cast("long").alias("len"),
        F.when(i == 0, F.length(b["role"]) + len(BEGIN + HEAD + BODY)).otherwise(F.lit(len(NEXT))).cast("long").alias("lead"),
        F.when(i == F.size(b["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).cast("long").alias("trail"),
        (b["role"] == learner).alias("learnt"),
    ))
    parts = blocks.select(
        "conv", F.array_join(F.transform("blocks", written), "").alias("formatted"),
        F.flatten(F.transform("blocks", lead)).alias("parts")
    )
    placed = parts.withColumn("at", prefix_sums(F.transform("parts", lambda p: p["lead"] + p["len"] + p["trail"])))
    spans = F.zip_with(
        "parts", "at",
        lambda p, a: F.struct((a + p["lead"]).alias("start"), (a + p["lead"] + p["len"]).alias("end"), p["learnt"].alias("learnt"))
    )
    mask = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"], s["end"]))
    return placed.select(F.col("conv").alias(conv), "formatted", mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role and text) of a formatted text."""
    blocks = F.split(formatted, END, -1)
    role = lambda b: unescape(F.substring_index(F.substr(b, F.lit(len(BEGIN + HEAD) + 1)), BODY, 1))
    body = lambda b: F.substr(b, F.locate(BODY, b) + len(BODY))
    texts = lambda b: F.split(body(b), r"\[TURN\]", -1)
    return F.flatten(
        F.transform(
            F.slice(blocks, 1, F.size(blocks) - 1),
            lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))
        )
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
