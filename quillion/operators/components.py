"""Connected components of an undirected graph by alternating large-star and small-star steps.

Both steps are one shuffle on a node id and shrink every component towards a star around its smallest
node (Kiveris et al., SoCC 2014). Each round is written to the shared folder, so a lost executor costs
one round and the plan stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.plans.scratch import Scratch


def connected_components(edges: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """`(node, root)` for every node of `edges`; the root is the smallest node of the component.

    Nodes may be of any type that sorts. Edges with a missing end and self-loops add nothing but, for a
    self-loop, its node. Repeated edges and either direction are allowed. An empty graph gives no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    kind = edges.schema[left].dataType
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    loops = scratch.keep(both.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    now = scratch.keep(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        total, stars = _signature(now)
        if total == 0 or stars == 0:
            break
        undirected = now.union(now.select("v", "u"))
        large = _least(undirected).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge now points from a larger node to a smaller one
        near = large.distinct()
        small = near.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        linked = small.select(F.explode("vs").alias("u"), F.col("m").alias("v")).where("u <> v")
        then = scratch.keep(linked.union(small.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now)
        now = then
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    every = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    out = every.union(loops.join(every.select("node"), "node", "left_anti")).select("node", "root")
    return out.select(F.col("node").cast(kind), F.col("root").cast(kind)) if isinstance(kind, T.AtomicType) else out


def _least(undirected: DataFrame) -> DataFrame:
    """Edges `(u, v)` with `m`, the smallest node among `u` and its neighbours."""
    m = undirected.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return undirected.join(m, "u")


def _signature(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of those that keep the graph from being a set of stars."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.col("u").alias("node"), one.alias("out"), none.alias("in")).union(edges.select("v", none, one))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    row = nodes.agg(F.coalesce(F.sum("out"), none), F.count_if((F.col("out") > 0) & (F.col("in") > 0)) + F.count_if(F.col("out") > 1)).first()
    return row[0], row[1]
