"""Sampling, calibration and verification of labelled findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def _dense_number(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `__n`, its place in `order` from 0: numbers within sorted range partitions, and a prefix of their counts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sums = local.groupBy("__part").agg(F.count("*").alias("__c"))
    before = sums.select("__part", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn("__n", F.col("__before") + F.col("__local") - 1).drop("__part", "__local", "__before")


def uniform_sample(df: DataFrame, order: str, size: int = 2000) -> DataFrame:
    """Rows at places k (N-1) div (S-1) of `order`, both ends included; everything if there are no more than `size`."""
    total = df.count()
    if total <= size:
        return df
    at = df.sparkSession.range(size).select(F.floor(F.col("id") * (total - 1) / (size - 1)).alias("__n"))
    return _dense_number(df, order).join(at, "__n", "left_semi").drop("__n")


def round_robin(df: DataFrame, by: str, order: list[str], per_group: int, limit: int) -> DataFrame:
    """The i-th row of each group in turn, groups by name, cut at `limit` behind the interleaving."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("turn") <= per_group).orderBy("turn", by).limit(limit)


def blind_digest(normalized: Column, path: Column, line: Column) -> Column:
    """The digest that gives an order without a hint of where a block came from."""
    return F.sha2(F.concat_ws("\0", normalized, path, line.cast("string")), 256)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def calibrated_thresholds(df: DataFrame, value: str, by: str, alerts: int, drift: int = 1) -> DataFrame:
    """`(by, threshold, fired)`: the threshold above which exactly `alerts` values lie.

    If ties rule that out, the nearest count within `drift`, fewer before more; a group with none has no row.
    """
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    at = counts.select(by, F.col(value).alias("threshold"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("fired"))
    below = df.groupBy(by).agg((F.min(value) - 1).alias("threshold"), F.count("*").alias("fired")).select(by, "threshold", "fired")
    off = F.abs(F.col("fired") - alerts)
    every = at.unionByName(below).where(off <= drift)
    best = Window.partitionBy(by).orderBy(off, "fired", F.desc("threshold"))
    return every.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(by, "threshold", "fired")


def precision_by_unit(fired: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`(unit, proposed, true)` from `fired(unit, id)` and `verdicts(id, yes)`, which must match one to one."""
    ids = fired.select("id").distinct()
    bad = ids.join(verdicts, "id", "left_anti").count() + verdicts.join(ids, "id", "left_anti").count()
    if bad or verdicts.groupBy("id").count().where("count > 1").take(1):
        raise ValueError("every block needs exactly one verdict")
    return fired.join(verdicts, "id").groupBy("unit").agg(F.count("*").alias("proposed"), F.count_if("yes").alias("true"))


def wilson(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """Rate and Wilson interval of `k` in `n`; null where `n` is 0."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = k / n
    mid = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    known = n.isNotNull()
    return p, F.when(known, F.greatest(mid - half, F.lit(0.0))), F.when(known, F.least(mid + half, F.lit(1.0)))


def gate(rate: Column, threshold: float | None) -> Column:
    """`PASS` if there is a rate and a threshold and the one is not above the other, else `RED`."""
    if threshold is None:
        return F.lit("RED")
    return F.when(rate <= threshold, "PASS").otherwise("RED")


def coverage(drawn: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """`(key, problem)`: what was drawn but not recorded, and the other way round."""
    a = drawn.join(recorded, key, "left_anti").select(key, F.lit("not recorded").alias("problem"))
    return a.union(recorded.join(drawn, key, "left_anti").select(key, F.lit("not drawn").alias("problem")))


def unexpected(found: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """Rows of a full outer join on `key` that differ from the pinned ones in any column."""
    names = [c for c in pinned.columns if c != key]
    both = found.select(key, F.struct(*names).alias("found")).join(pinned.select(key, F.struct(*names).alias("pinned")), key, "full_outer")
    return both.where(~F.col("found").eqNullSafe(F.col("pinned")))


def first_after(left: DataFrame, right: DataFrame, by: str, at: str, out: str) -> DataFrame:
    """`left` with `out`, the least `at` of `right` in the same group that is greater; one sort, no range join."""
    every = left.select(*left.columns, F.lit(0).alias("__side"), F.lit(None).cast(right.schema[at].dataType).alias("__at")).unionByName(
        right.select(by, at, F.lit(1).alias("__side"), F.col(at).alias("__at")), allowMissingColumns=True
    )
    ahead = Window.partitionBy(by).orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    return every.withColumn(out, F.min("__at").over(ahead)).where("__side = 0").drop("__side", "__at")
