"""Tables of text as prose blocks and as Python sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.sources.extract import with_sizes


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores if it is read in fewer parts than two for each core, as small files of one row group are.

    A large table has far more parts than that, and its texts are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def blocks_from_text(docs: DataFrame) -> DataFrame:
    """Each document as one block of a file of its own: even ids are docstrings, odd ones comments."""
    raw = spread(docs.select("doc_id", "source", "text")).select(
        "doc_id",
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, "docstring").otherwise("comment").alias("kind"),
        F.lit(1).alias("line_start"),
        (F.size(F.split("text", "\n", -1))).alias("line_end"),
        F.col("text").alias("raw"),
        F.lit(None).cast("string").alias("line_above"),
    )
    return with_sizes(raw)


def rendered_sources(docs: DataFrame) -> DataFrame:
    """`(path, content)`: each document as a Python file that holds it as a run of comments."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(x == "", "#").otherwise(F.concat(F.lit("# "), x)))
    return spread(docs.select("doc_id", "source", "text")).select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.array_join(lines, "\n"), F.lit("\n\nvalue = 1\n")).cast("binary").alias("content"),
    )
