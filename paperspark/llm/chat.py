"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted, adjacent turns of one role are
merged into a segment, and segments are joined into one string::

    <s>[ROLE]user[/ROLE]first text[TURN]second text</s><s>[ROLE]assistant...

Control strings inside a role or text get one extra backslash after their
first character; reading back removes it, so every text returns unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, as one pattern: first character, then any
# backslashes that an earlier escape has put there, then the rest.
CONTROL_RE = r"([<\[])(\\*(?:/?s>|/?INST\]|/?ROLE\]|TURN\]))"
ESCAPED_RE = r"([<\[])\\(\\*(?:/?s>|/?INST\]|/?ROLE\]|TURN\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_RE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED_RE, "$1$2")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """One formatted string per conversation.

    Returns ``conv_id, formatted, loss_mask``. ``loss_mask`` is run-length
    coded over the code points of ``formatted``: an array of (chars, loss),
    where loss marks assistant texts. Rows are ordered by turn, then role,
    then text, so ties and repeated rows have one defined order and are all
    kept. A null turn sorts first; a null role or text is the empty string;
    rows with a null conversation form one conversation of their own. Other
    columns are ignored. A conversation's string is one value, so its turns
    must fit in one row; conversations are spread by key and their turns are
    never shuffled twice.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"),
                 F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Index of the first turn of every run of one role.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    convs = convs.withColumn("starts", starts)
    runs = F.transform(
        "starts", lambda s, k: F.slice(
            "turns", s + 1,
            F.coalesce(F.get("starts", k + 1), F.size("turns")) - s))
    convs = convs.select("conv_id", runs.alias("runs"))
    segments = F.transform("runs", lambda run: F.struct(
        F.concat(F.lit("<s>[ROLE]"), escape(F.get(run, F.lit(0))["role"]), F.lit("[/ROLE]")).alias("head"),
        (F.get(run, F.lit(0))["role"] == "assistant").alias("loss"),
        F.transform(run, lambda t: escape(t["text"])).alias("texts")))
    convs = convs.select("conv_id", segments.alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: F.concat(
        s["head"], F.array_join(s["texts"], "[TURN]"), F.lit("</s>"))), "")
    mask = F.flatten(F.transform("segments", lambda s: F.concat(
        F.array(F.struct(F.length(s["head"]).alias("chars"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(s["texts"], lambda t, i: F.array(
            F.struct(F.length(t).alias("chars"), s["loss"].alias("loss")),
            # "[TURN]" follows a text, "</s>" the last one of a segment.
            F.struct(F.when(i + 1 < F.size(s["texts"]), 6).otherwise(4).alias("chars"),
                     F.lit(False).alias("loss"))))))))
    return convs.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Turns read back from formatted strings: ``conv_id, formatted, turns``
    with turns an array of (role, text, loss) in order. A null string has no
    turns."""
    segments = F.filter(F.split(F.coalesce("formatted", F.lit("")), "</s>"), lambda s: s != "")
    parts = F.transform(segments, lambda s: F.split(s, r"\[/ROLE\]", 2))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(
        F.split(F.get(p, F.lit(1)), r"\[TURN\]"),
        lambda t: F.struct(
            unescape(F.substring_index(F.get(p, F.lit(0)), "<s>[ROLE]", -1)).alias("role"),
            unescape(t).alias("text"),
            (F.get(p, F.lit(0)) == "<s>[ROLE]assistant").alias("loss")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))
