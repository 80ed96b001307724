"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text (this
template's and those of the [INST] family) get a backslash after their first character, and
backslashes are doubled first, so the text can be read back exactly. Roles are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"\||/?s>|/?INST\]"


def escaped(text):
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={_CONTROL})", r"$1\\")


def unescaped(text):
    return F.replace(F.regexp_replace(text, rf"([<\[])\\(?={_CONTROL})", "$1"), F.lit("\\\\"), F.lit("\\"))


def format_prefix_target(turns: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row for each example.

    Each assistant turn gives an example: ``formatted`` is every turn up to it, ``loss_start`` and
    ``loss_length`` (code points) mark its text, the only trainable part. Turns after the last
    assistant turn, or a conversation without one, give one more row with the whole conversation and
    an empty mask, so every turn can be read back. ``example`` counts from 0 by turn.

    Rows are ordered by turn, then role, then text, nulls first; repeated rows stay. A null text is
    empty, a null role an empty role. Rows of a null conv_id are one conversation. Other columns
    aren't read. A conversation must fit in a row, as its last example is one.
    """
    one = turns.select(
        "conv_id",
        F.struct(
            "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    gathered = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    written = gathered.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("target"),
                F.concat(F.lit(START), F.url_encode(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("ts"),
    )
    n = F.size("ts")
    ends = F.filter(
        F.transform("ts", lambda t, i: F.when(F.coalesce(t["target"], F.lit(False)) | (i == n - 1), i)), lambda i: i.isNotNull()
    )
    at = written.select("conv_id", "ts", F.posexplode(ends).alias("example", "at"))
    last = F.get("ts", F.col("at"))
    whole = F.array_join(F.transform(F.slice("ts", 1, F.col("at") + 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    done = at.select("conv_id", "example", whole.alias("formatted"), last.alias("last"))
    trains = F.coalesce(F.col("last.target"), F.lit(False))
    return done.select(
        "conv_id",
        "example",
        "formatted",
        F.when(trains, F.length("formatted") - F.length("last.body") - len(END)).otherwise(F.length("formatted")).cast("long").alias("loss_start"),
        F.when(trains, F.length("last.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def parsed_turns(formatted):
    """The turns of a formatted string, as ``array<struct<role, text>>``."""
    parts = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from the formatted strings alone."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(
            F.collect_list(F.struct("example", F.expr("substring(formatted, loss_start + 1, loss_length)").alias("reply")))
        ).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = parsed_turns(F.col("whole"))
    read = per.select(
        "conv_id", "formatted_chars", turns.alias("turns"),
        F.array_join(F.transform("replies", lambda r: unescaped(r["reply"])), "").alias("loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
