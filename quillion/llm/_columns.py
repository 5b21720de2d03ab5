"""Column names that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column has it, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame) -> DataFrame:
    """`df` with its columns named c0, c1 and so on, so that no name can clash with a helper's; undone by `toDF`."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
