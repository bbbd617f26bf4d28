"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes one training example: all turns before it as
context, and the loss mask over that reply alone.  Turns are marked by control
strings; the same strings inside texts or roles get a backslash after their
first character (and one more where some stand there already), which
``unescape`` takes away again, so every text can be read back as it was.

Defined cases: a null text or role is empty; turns are ordered by (turn, role,
text) with nulls first, so ties and repeated rows have one order; a row without
a conversation id is a conversation of its own; a conversation that does not
end on an assistant turn gets one more example, of all its turns, with an empty
loss mask (null bounds), so no turn is lost; an empty table gives no examples.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# What may not appear unescaped in a text, as first character and rest.
_REST = r"(\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\])"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("turns"))
    return known.unionByName(alone)


def prefix_target_examples(rows: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per trainable turn: (conv_id, n_turns, formatted, loss_start, loss_end).

    ``n_turns`` counts the turns shown, the target last.  ``formatted`` holds
    characters ``[loss_start, loss_end)`` under the loss mask, counted from 0 in
    code points.  The output repeats each turn once per later target; that is
    what the format asks for.
    """
    pieces = F.transform("turns", lambda t: F.concat(
        F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)))
    roles = F.transform("turns", lambda t: t["role"])
    n = F.size("pieces")
    shown = F.filter(F.sequence(F.lit(1), n),
                     lambda k: (F.get("roles", k - 1) == target_role) | (k == n))
    examples = (
        conversation_turns(rows)
        .select("conv_id", pieces.alias("pieces"), roles.alias("roles"))
        .select("conv_id", "pieces", "roles", F.explode(shown).alias("n_turns"))
        .select("conv_id", "n_turns",
                F.array_join(F.slice("pieces", 1, F.col("n_turns")), "").alias("formatted"),
                F.length(F.get("pieces", F.col("n_turns") - 1)).alias("_last"),
                F.get("roles", F.col("n_turns") - 1).alias("_role"))
    )
    head = F.length(escape(F.col("_role"))) + len(TURN) + len(TEXT)
    start = F.length("formatted") - F.col("_last") + head
    trainable = F.col("_role") == target_role
    return examples.select(
        "conv_id", "n_turns", "formatted",
        F.when(trainable, start).alias("loss_start"),
        F.when(trainable, F.length("formatted") - len(END)).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns, trained text and size."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(
        F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    grouped = (
        # Examples without a conversation id stand alone and must not meet in one group.
        examples.withColumn("_alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
        .select("conv_id", "_alone", "n_turns", "formatted", loss.alias("loss"))
        .groupBy("conv_id", "_alone")
        .agg(F.max_by("formatted", "n_turns").alias("longest"),
             F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
                 F.col("loss").isNotNull(), F.struct("n_turns", "loss")))), lambda x: x["loss"]), "").alias("loss"),
             F.sum(F.length("formatted")).alias("formatted_chars"))
    )
    parts = F.split("longest", r"<\|end\|>")
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(
        unescape(F.substring(F.substring_index(p, TEXT, 1), len(TURN) + 1, 1 << 30)), F.lit("\n"),
        unescape(F.substring_index(p, TEXT, -1)), F.lit("\n")))
    return grouped.withColumn("_turns", turns).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
