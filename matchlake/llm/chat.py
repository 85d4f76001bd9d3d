"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all preceding turns are its context, and only that reply is
trainable. A conversation's turns after its last reply (or all of them, where there is none) make one more
example without a trainable span, so that the output holds every turn. The template is
<|im_start|>role newline text<|im_end|> newline. Control strings inside roles and texts are escaped with a
backslash code that unescape() reverses exactly.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; turns sort by
turn (null first), then role, then text, so ties and repeated rows keep a fixed order; an empty table gives
no examples. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Raw string and its escape, in the order of escaping. After the first, each backslash begins an escape.
ESCAPES = (("\\", "\\b"), ("<|", "<\\p"), ("\n", "\\n"))


def escape(text: Column, newlines: bool = False) -> Column:
    for raw, coded in ESCAPES[: 3 if newlines else 2]:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, newlines: bool = False) -> Column:
    for raw, coded in reversed(ESCAPES[: 3 if newlines else 2]):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (1, 2, ...), n_turns in it, formatted, and the trainable span [mask_start, mask_end)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _turn_order).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(STOP)))
    convs = convs.select("conv_id", "turns", piece.alias("pieces"), F.size("turns").alias("n"))
    replies = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: F.element_at("turns", k)["role"] == "assistant")
    last = F.coalesce(F.array_max("ends"), F.lit(0))
    convs = convs.withColumn("ends", replies).withColumn("ends", F.when(last < F.col("n"), F.array_append("ends", F.col("n"))).otherwise(F.col("ends")))
    rows = convs.select("conv_id", "pieces", "turns", F.posexplode("ends").alias("at", "upto"))
    target = F.element_at("turns", F.col("upto"))
    rows = rows.select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        F.col("upto").alias("n_turns"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("upto")), "").alias("formatted"),
        (target["role"] == "assistant").alias("trainable"),
        F.length(escape(target["text"])).alias("_reply"),
    )
    stop = F.length("formatted") - F.lit(len(STOP))
    return rows.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("trainable"), stop - F.col("_reply")).alias("mask_start"), F.when(F.col("trainable"), stop).alias("mask_end"))


def _turn_order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for name in ("text", "role"):
        out = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(out)
    x, y = a["turn"], b["turn"]
    return F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns that a formatted text holds."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(
        bare,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1), True).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Each conversation as its examples hold it: turns (role, text), the trainable text, characters written."""
    reply = F.when(F.col("mask_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start"))))
    held = examples.groupBy("conv_id").agg(
        F.max_by("formatted", F.struct("n_turns", "example")).alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", reply.alias("reply")))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    return held.select("conv_id", turns_of(F.col("whole")).alias("turns"), F.array_join(F.transform("replies", lambda r: F.coalesce(r["reply"], F.lit(""))), "").alias("trained"), "formatted_chars")
