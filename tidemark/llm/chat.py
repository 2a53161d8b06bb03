"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable.
Turns after the last reply become one closing example without a trainable span, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings that texts may hold: a backslash goes behind the first character, and backslashes are doubled.
_CONTROL = r"([<\[])(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Reversible; its result holds no control string."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: ``conv_id, example, text, loss_start, loss_chars``.

    The loss mask is the span of ``loss_chars`` characters at ``loss_start`` (from 0) of ``text``: the escaped reply.
    Rows go by turn, ties by role and text; a null turn comes first; null roles and texts are empty; repeated rows are
    turns of their own; rows of a null id form one conversation. Other columns are ignored. An empty table gives no rows.
    The work on a conversation is one row, so one conversation has to fit into a row; the examples of a conversation hold
    its turns again and again, as the expansion demands.
    """
    chats = (
        turns.select(
            F.col(id_col).alias("conv_id"),
            F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
    )
    parts = chats.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == "assistant").alias("reply"),
        F.transform("ts", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).alias("heads"),
        F.transform("ts", lambda t: escape(t["raw"])).alias("bodies"),
    )
    last = F.size("bodies") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("reply", i) | (i == last))
    examples = parts.select("conv_id", "reply", "heads", "bodies", F.posexplode(ends).alias("example", "at"))
    before = F.zip_with(F.slice("heads", F.lit(1), F.col("at")), F.slice("bodies", F.lit(1), F.col("at")), lambda h, b: F.concat(h, b, F.lit(END)))
    return (
        examples.withColumn("context", F.concat(F.array_join(before, ""), F.get("heads", F.col("at"))))
        .withColumn("body", F.get("bodies", F.col("at")))
        .select(
            "conv_id",
            F.col("example").cast("long").alias("example"),
            F.concat("context", "body", F.lit(END)).alias("text"),
            F.char_length("context").cast("long").alias("loss_start"),
            F.when(F.get("reply", F.col("at")), F.char_length("body")).otherwise(0).cast("long").alias("loss_chars"),
        )
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted example, as an array of ``role, text``."""
    body = F.regexp_replace(text, r"<\|end\|>\n$", "")
    halves = F.transform(F.split(body, r"<\|end\|>\n"), lambda x: F.split(F.substring(x, F.lit(len(TURN) + 1), F.char_length(x)), r"<\|text\|>"))
    return F.transform(halves, lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and the loss mask alone: the digests of its turns and of what is trained on."""
    masked = F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))
    each = examples.select(
        "conv_id",
        F.struct("example", unescape(masked).alias("loss")).alias("learnt"),
        F.char_length("text").cast("long").alias("chars"),
        F.struct("example", "text").alias("whole"),
    )
    per_chat = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("learnt"))["loss"].alias("losses"), F.sum("chars").alias("formatted_chars"), F.max("whole")["text"].alias("whole"))
    per_chat = per_chat.select("conv_id", "formatted_chars", F.array_join("losses", "").alias("loss"), parse_turns(F.col("whole")).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per_chat.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
