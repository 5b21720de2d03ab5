"""Multi-party chat formatting by perspective rotation (operator 9).

Every participant of a conversation gets one rendering in which that speaker is the assistant, the others
are users with their names, and the mask covers what the assistant says. The turns of a conversation meet in one
shuffle; everything else is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _safe(c):
    """Text in which a delimiter can't be forged: its bar is doubled."""
    return F.replace(F.replace(c, F.lit("<|im_"), F.lit("<||im_")), F.lit("\r\n"), F.lit("\n"))


def _system(role):
    return F.lower(F.trim(role)) == SYSTEM


def _name(role):
    """A speaker's name on one line, in which no delimiter can be forged."""
    return F.regexp_replace(_safe(role), "[\r\n\\x{85}\\x{2028}\\x{2029}]+", " ")


def rotate(conversations: DataFrame) -> DataFrame:
    """`(conv_id, speaker, n_turns, n_own, text, mask)`: one row for each conversation and participant.

    Turns go by `turn`, then role, then text; ties and repeated rows all stay, in that order. The role `system`, in
    either case and with spaces around it, is no participant and is rendered as the system in every rotation. A turn with a null conversation, role or
    turn number is left out; a null text is an empty one. `text` is each turn as
    `<|im_start|>assistant`, `<|im_start|>user name=ROLE` or `<|im_start|>system`, a line feed, the text and
    `<|im_end|>`. `mask` lists the character ranges `start:end`, joined by commas, that are learned: the
    assistant's texts with their end mark. Delimiters inside texts and roles are defused, and line
    breaks in roles are spaces; `speaker` is the role as it is. A conversation of system
    turns alone has no row. Other columns, of whatever name, are not read.
    """
    turns = conversations.select("conv_id", "turn", "role", _safe(F.coalesce("text", F.lit(""))).alias("text")).where("conv_id is not null and turn is not null and role is not null")
    dialogue = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: ~_system(r))))
    each = dialogue.select("conv_id", "turns", F.explode(speakers).alias("speaker"))
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.concat(F.lit(OPEN), F.when(own(t), "assistant").when(_system(t["role"]), SYSTEM).otherwise(F.concat(F.lit("user name="), _name(t["role"]))), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(own(t).alias("own"), head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body")))
    shown = each.select("conv_id", "speaker", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate(
        "parts",
        start,
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(s["spans"], F.array(F.concat_ws(":", s["at"] + F.length(p["head"]), s["at"] + F.length(p["head"]) + F.length(p["body"]))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: F.array_join(s["spans"], ","),
    )
    return shown.select(
        "conv_id",
        "speaker",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        spans.alias("mask"),
    )
