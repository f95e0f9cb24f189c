"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trainable.  DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles
``<|`` gets a backslash after ``<`` (as does ``<`` with backslashes before ``|``,
so that the escape is reversible); in roles a line feed is written ``</`` in the
same way.  No text can therefore forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"<(\\*)([|/])", r"<\\$1$2"), F.lit("\n"), F.lit("</"))


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("</"), F.lit("\n")), r"<\\(\\*)([|/])", r"<$1$2")


def format_examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars, last) rows.

    ``example`` is the position (from 0) of the target turn; ``formatted`` ends
    with that turn; ``loss_start`` (from 0) and ``loss_chars`` delimit the
    trainable text in characters.  Turns that no later assistant turn follows
    are kept in one more row without loss, so each conversation's ``last`` row
    holds all its turns.  Turns are ordered by turn number, null first, ties by
    role and text; null text and role are empty; repeated rows are turns of
    their own; rows without conv_id make one conversation.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    written = whole.select(
        "conv_id",
        F.transform(
            "t",
            lambda x: F.struct(
                (x["role"] == "assistant").alias("target"),
                F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"),
                escape_text(x["text"]).alias("body"),
            ),
        ).alias("t"),
    ).withColumn("segs", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))))
    ends = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: F.element_at("t", i + 1)["target"] | (i == F.size("t") - 1),
    )
    one = written.select("conv_id", "t", "segs", F.explode(ends).alias("example"))
    at = F.element_at("t", F.col("example") + 1)
    return one.select(
        "conv_id",
        "example",
        F.array_join(F.slice("segs", F.lit(1), F.col("example") + 1), "").alias("formatted"),
        F.when(
            at["target"],
            F.length(F.array_join(F.slice("segs", F.lit(1), F.col("example")), "")) + F.length(at["head"]),
        ).alias("loss_start"),
        F.when(at["target"], F.length(at["body"])).otherwise(0).alias("loss_chars"),
        (F.col("example") == F.size("t") - 1).alias("last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape_text(
                F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)
            ).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its formatted examples.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n per turn), loss_chars and
    loss_sha256 (all text under the loss mask, unescaped, in order), and
    formatted_chars (of all its examples).
    """
    x = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(
            F.col("loss_start").isNotNull(),
            unescape_text(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars"))),
        ).alias("loss"),
        F.when(F.col("last"), read_turns(F.col("formatted"))).alias("turns"),
    ).select(
        "conv_id",
        "example",
        "chars",
        "loss",
        F.size("turns").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns"),
    )
    return (
        x.groupBy("conv_id")
        .agg(
            F.max("n").cast("long").alias("n_turns"),
            F.max("turns").alias("turns_sha256"),
            F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
            F.sum("chars").alias("formatted_chars"),
        )
        .withColumn("all_loss", F.array_join(F.transform("losses", lambda t: t["loss"]), ""))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("all_loss").cast("long").alias("loss_chars"),
            F.sha2("all_loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
