"""All findings of a set of blocks, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions.markers import silenced, suppression
from quillion.functions.text import kind_rank
from quillion.operators.similarity import cluster_findings, clusters
from quillion.operators.volume import COMMENT_MAX, DOCSTRING_MAX, volume_findings


@dataclass(frozen=True)
class Config:
    comment_max: int = COMMENT_MAX
    docstring_max: int = DOCSTRING_MAX
    ignore: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def findings(blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """`(code, path, line, end_line, prose_kind, message, words, max_volume, locations, weakest)`, sorted.

    A marker on the line above silences a block for a code; blocks are silenced before they are clustered,
    so that the rest of a cluster is scored anew. An ignored code is never computed. One block may
    have a finding of each kind.
    """
    seen = blocks.withColumn("supp", suppression(F.col("line_above")))
    code = F.when(F.col("kind") == "comment", "TPX001").otherwise("TPX002")
    loud = seen.where(~silenced(F.col("supp"), code) & ~code.isin(*config.ignore) if config.ignore else ~silenced(F.col("supp"), code))
    out = volume_findings(loud, config.comment_max, config.docstring_max)
    if "TPX003" not in config.ignore:
        again = cluster_findings(clusters(seen.where(~silenced(F.col("supp"), "TPX003"))))
        out = out.unionByName(again, allowMissingColumns=True)
    else:
        place = "struct<path:string,line:int,end_line:int,prose_kind:string>"
        out = out.withColumn("locations", F.lit(None).cast(f"array<{place}>")).withColumn("weakest", F.lit(None).cast(f"struct<first:{place},second:{place},similarity:double>"))
    return out.orderBy("path", "line", "end_line", kind_rank(F.col("prose_kind")), "code", "message")
