"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the turns before it are context, and only that
reply is trainable. A conversation that does not end with an assistant turn gets one more example
of all its turns, with nothing trainable, so that the output holds every turn.

A turn is written as ``<|turn|>ROLE\\nTEXT<|end|>``. Control strings inside texts and roles are
escaped: their first character becomes ``%`` and its hexadecimal code, and so does every ``%``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import quoted

TURN, END = "<|turn|>", "<|end|>"
#: The template's own control strings and those of other common templates.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]")
_COMMON = (("<", "%3C"), ("[", "%5B"), ("\n", "%0A"), ("%", "%25"))


def escaped(text: Column, role: bool = False) -> Column:
    """The text without any control string; a role also without line breaks."""
    text = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(dict(_COMMON)[c[0]] + c[1:]))
    return F.replace(text, F.lit("\n"), F.lit("%0A")) if role else text


def unescaped(text: Column) -> Column:
    for plain, code in _COMMON:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row an example: conv_id, example (from 1), formatted, loss_start and loss_end (code points, end exclusive), is_last.

    Turns go by turn number (null first), then role, then text; repeated rows are turns of
    their own. Null texts and roles count as empty. Rows with a null conv_id form one conversation.
    loss_start and loss_end are null where nothing is trainable. Other input columns don't count, whatever their names.
    An empty table gives no rows. A conversation is put together in one task, and its examples are quadratic in its turns, as the output is; texts may
    be as long as one row allows. Where many rows may lack a conv_id, name them first, or they make one conversation of that size.
    """
    turns = df.select(
        quoted(conv_col).alias("conv_id"),
        F.struct(quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col), F.lit("")).alias("role"), F.coalesce(quoted(text_col), F.lit("")).alias("text")).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    is_target = F.transform("turns", lambda t: t["role"] == F.lit(target_role))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(is_target, i) | (i == n))
    written = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escaped(t["role"], role=True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == F.lit(target_role)).alias("target")))
    at = F.expr("written[end - 1]")
    context = F.array_join(F.expr(f"transform(slice(written, 1, end - 1), t -> concat(t.head, t.body, '{END}'))"), "")
    begin = F.length("context") + F.length(at["head"])
    return (
        convs.select("conv_id", written.alias("written"), F.posexplode(ends).alias("pos", "end"), n.alias("n"))
        .withColumn("context", context)
        .select(
            "conv_id",
            (F.col("pos") + 1).alias("example"),
            F.concat("context", at["head"], at["body"], F.lit(END)).alias("formatted"),
            F.when(at["target"], begin).alias("loss_start"),
            F.when(at["target"], begin + F.length(at["body"])).alias("loss_end"),
            (F.col("end") == F.col("n")).alias("is_last"),
        )
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array<struct<role, text>>."""
    segments = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda s: s != F.lit(""))
    start = len(TURN) + 1
    return F.transform(
        segments,
        lambda s: F.struct(
            unescaped(F.substring_index(F.substring(s, start, 1 << 30), "\n", 1)).alias("role"),
            unescaped(F.substring(s, F.instr(s, "\n") + 1, F.lit(1 << 30))).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The trainable text of an example, unescaped; null where there is none."""
    return unescaped(F.substring(formatted, loss_start + F.lit(1), loss_end - loss_start))


def digest(made: DataFrame) -> DataFrame:
    """What a reader of the examples finds, one row a conversation: its turns, and the text under the loss mask.

    `made` is the output of `examples`; a null conv_id is a conversation. A conversation without a target has an empty loss text, one whose texts are
    empty has its turns all the same. No examples give no rows; other columns don't count.
    """
    text = loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    by_conv = (
        made.select("conv_id", "example", text.alias("loss"), F.length("formatted").cast("long").alias("chars"), F.when(F.col("is_last"), F.col("formatted")).alias("full"))
        .groupBy("conv_id")
        .agg(F.max("full").alias("full"), F.sum("chars").alias("formatted_chars"), F.count("loss").alias("n_targets"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"))
        .withColumn("turns", turns_of(F.col("full")))
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by_conv.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_targets",
    )
