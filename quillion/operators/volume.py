"""Blocks that are longer than their kind's limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions.text import address, volume_message

COMMENT_MAX, DOCSTRING_MAX = 150, 200
CODES = {"comment": "TPX001", "docstring": "TPX002"}


def volume(blocks: DataFrame, comment_max: int = COMMENT_MAX, docstring_max: int = DOCSTRING_MAX) -> DataFrame:
    """`blocks` over the limit, with `code`, `words` and `max_volume`. A block of exactly the limit passes."""
    comment = F.col("kind") == "comment"
    most = F.when(comment, comment_max).otherwise(docstring_max)
    code = F.when(comment, CODES["comment"]).otherwise(CODES["docstring"])
    return blocks.where(F.col("size_words") > most).select("*", code.alias("code"), F.col("size_words").alias("words"), most.alias("max_volume"))


def volume_findings(blocks: DataFrame, comment_max: int = COMMENT_MAX, docstring_max: int = DOCSTRING_MAX) -> DataFrame:
    over = volume(blocks, comment_max, docstring_max)
    at = address(F.col("path"), F.col("line_start"), F.col("line_end"))
    return over.select(
        "code",
        "path",
        F.col("line_start").alias("line"),
        F.col("line_end").alias("end_line"),
        F.col("kind").alias("prose_kind"),
        volume_message(at, F.col("code"), F.col("kind"), F.col("words"), F.col("max_volume")).alias("message"),
        "words",
        "max_volume",
    )
