"""Tables written to a folder that all executors share, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the session runs on one
machine, as in tests, a temporary folder is made; a cluster without the setting is an error. A written table
survives the loss of executors and is computed once, unlike a cached one. Tables that nothing will read again
are dropped: all of a scratch but the last with `finish`.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillion-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """`df` as written to the shared folder and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillion_path = path
        self.kept.append(out)
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """`df` as written, when all other tables of this scratch are removed."""
        before, self.kept = self.kept, []
        out = self.keep(df)
        for table in before:
            self.drop(table)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing will read again."""
        path = getattr(df, "_quillion_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 4) -> None:
    """Lower the session's limits of Arrow batches to these, for good, where a plan is returned before it runs.

    Rows of long texts then take less memory in Python workers and beside the heap. Results don't depend on it.
    """
    for k, most in {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": megabytes << 20}.items():
        old = int(spark.conf.get(k).rstrip("b"))
        spark.conf.set(k, str(min(most, old) if old > 0 else most))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int, megabytes: int = 4):
    """Arrow batches of at most `rows` rows and about `megabytes` in what runs inside: long texts then take less memory."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": megabytes << 20}
    before = {k: spark.conf.get(k) for k in limits}
    for k, most in limits.items():
        old = int(before[k].rstrip("b"))
        spark.conf.set(k, str(min(most, old) if old > 0 else most))
    try:
        yield
    finally:
        for k, old in before.items():
            spark.conf.set(k, old)


@contextlib.contextmanager
def no_old_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
