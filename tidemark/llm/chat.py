"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all preceding turns are context, that reply alone is
trainable (``loss_start``, ``loss_end``: code points, end exclusive). A conversation that does not
end in an assistant turn also gets one example without a target, whose mask is empty, so that the
formatted output always holds every turn.

Template: ``<|turn|>role`` newline ``text<|end|>`` newline. Inside roles and texts ``&``, ``<`` and
``[`` (and newlines in roles) are written as entities, so neither this template's marks nor other
common control strings can occur there; reading back reverses that exactly.

Null texts and roles are empty. A null conversation id is one conversation. Turns sort by (turn,
role, text), nulls first, so ties and repeated rows are ordered and kept. Empty tables give empty
results. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Characters that control strings need, and how texts write them, in order.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def conversations_of(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (array of role, text in order). A conversation is the
    unit of the operator: its turns meet in one row."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    packed = F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("turns"))


def examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Prefix-target examples: conv_id, n_turns, target (turn index, null for a tail without target),
    formatted, loss_start, loss_end, is_last (the example that holds the whole conversation)."""
    size = F.size("turns")
    ends = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (F.get("turns", i)["role"] == target_role) | (i == size - 1),
    )
    marked = F.transform("turns", lambda x: F.concat(F.lit(TURN), F.replace(escaped(x["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"), escaped(x["text"]), F.lit(END + "\n")))
    out = conversations.select("conv_id", "turns", marked.alias("marked"), size.alias("n_turns"), F.explode(ends).alias("at"))
    trained = F.get("turns", F.col("at"))["role"] == target_role
    out = out.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.when(trained, F.col("at")).alias("target"),
        F.array_join(F.slice("marked", 1, F.col("at") + 1), "").alias("formatted"),
        F.when(trained, F.length(escaped(F.get("turns", F.col("at"))["text"]))).otherwise(0).alias("reply"),
        (F.col("at") == F.col("n_turns") - 1).alias("is_last"),
    )
    end = F.length("formatted") - len(END) - 1
    return out.withColumns({"loss_end": F.when(F.col("target").isNotNull(), end).otherwise(0)}).withColumn("loss_start", F.col("loss_end") - F.col("reply")).drop("reply")


def read_turns(formatted: Column) -> Column:
    """Turns back from a formatted text: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
            unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescaped(F.substring(formatted, start + 1, end - start))


def digests(made: DataFrame) -> DataFrame:
    """What each conversation's examples say when read back: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    turns = read_turns(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = made.select(
        "conv_id",
        F.coalesce(F.col("target"), F.lit(2**31 - 1)).alias("at"),
        F.when(F.col("is_last"), F.size(turns)).alias("n"),
        F.when(F.col("is_last"), F.sha2(flat, 256)).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "loss"))), lambda x: x["loss"]), "")
    out = read.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("turns").alias("turns_sha256"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
