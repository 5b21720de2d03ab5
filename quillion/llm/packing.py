"""Bulk-synchronous best-fit packing (operator 7).

Documents are cut into pieces of at most a bin. Pieces are range-sorted by size once, and every round
range-sorts the gaps. A sweep over both orders gives each size the smallest gaps that hold it; pieces that
want the same gap are resolved by rank, so that the r-th piece meets the r-th gap of a run. Gaps shrink, and
the next round follows. Larger pieces go first, an octave of sizes at a time; when no piece of the octave fits
any gap, as many bins open at once as the octave's volume needs at least.

Ranks come from the sorted range partitions: each numbers its own rows and sums them by size, and the
prefix of these sums says where each partition's ranks begin. Those sums, at most one number a size and
partition, are all that the driver sees; rows stay where they are and only gaps move. Every round is
written to the shared folder.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import _vec
from quillion.plans.scratch import Scratch

CAPACITY = 2048
#: Pieces of at most this part of a bin are the last octave.
LAST = 4


def word_counts(docs: DataFrame) -> DataFrame:
    """`(doc_id, size)`: words of every text, 0 for a null one."""

    def run(it):
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.zeros(len(texts), dtype=np.int64)
            is_word, _ = _vec.tables()
            for a, b in _vec.slices([len(t) for t in texts], 1 << 20):
                cps, starts = _vec.code_points(texts[a:b])
                mask = is_word[cps]
                first = np.flatnonzero(mask & ~np.concatenate(([False], mask[:-1])))
                n[a:b] = np.diff(np.searchsorted(first, starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["doc_id", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long")


def sweep(need: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of sizes to gaps: runs `(gap, first gap rank, gaps, size, first piece rank, pieces a gap)`.

    Sizes go from the largest; each takes the smallest gaps that hold it and are still untouched in this
    round, and fills a gap with as many equal pieces as it holds.
    """
    order = sorted(g for g, c in gaps.items() if c)
    after = list(range(len(order) + 1))  # the next class with a free gap, with path halving

    def find(i):
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    used = [0] * len(order)
    runs = []
    for size in sorted(need, reverse=True):
        rank, left = 0, need[size]
        i = find(bisect_left(order, size))
        while left and i < len(order):
            gap, free = order[i], gaps[order[i]] - used[i]
            each = gap // size
            n = min(free, left // each)
            if n:
                runs.append((gap, used[i], n, size, rank, each))
            elif left:
                n, each = 1, left
                runs.append((gap, used[i], 1, size, rank, each))
            used[i] += n
            rank += n * each
            left -= n * each
            if used[i] == gaps[gap]:
                after[i] = i + 1
                i = find(i)
    return runs


def _ranked(df: DataFrame, parts: int, size: str, *ties: str) -> DataFrame:
    """`df` range-sorted by `size` and `ties`, with the partition and the rank in it among rows of one size."""
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    where = df.columns.index(size)

    def number(it):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in it:
            s = np.array(batch.column(where))
            if not len(s):
                continue
            first = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
            local = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
            if s[0] == last:
                local[: first[1] if len(first) > 1 else len(s)] += seen
            last, seen = s[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(s), part, dtype=np.int32)), pa.array(local)], names=[*batch.schema.names, "part", "local"])

    return df.repartitionByRange(parts, size, *ties).sortWithinPartitions(size, *ties).mapInArrow(number, schema)


def _sums(df: DataFrame, size: str) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Rows of each size, and the rank with which each partition begins a size."""
    total: dict[int, int] = {}
    begin = {}
    for part, s, n in sorted(tuple(r) for r in df.groupBy("part", size).agg(F.count("*")).collect()):
        begin[part, s] = total.get(s, 0)
        total[s] = total.get(s, 0) + n
    return total, begin


def _ranks(part, size, local, begin):
    """Ranks of rows: those in their partition plus where it begins."""
    out = np.array(local)
    both = np.stack([np.array(part, dtype=np.int64), np.array(size, dtype=np.int64)], 1)
    if len(both):
        cut = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1), [True])))
        for a, z in zip(cut[:-1], cut[1:]):
            out[a:z] += begin[int(both[a, 0]), int(both[a, 1])]
    return out


_GAPS = "bin long, gap long, size long, first long, each long"


def _fill(shared):
    """Gaps after a round: each row finds the run that holds its rank, takes that run's pieces and shrinks."""

    def run(it):
        runs, begin = shared.value
        by_gap: dict[int, np.ndarray] = {}
        for r in runs:
            by_gap.setdefault(r[0], []).append(r)
        by_gap = {g: np.array(v, dtype=np.int64) for g, v in by_gap.items()}
        for batch in it:
            gap = np.array(batch.column(1))
            rank = _ranks(batch.column(2), gap, batch.column(3), begin)
            size, first, each = (np.zeros(len(gap), dtype=np.int64) for _ in range(3))
            for g in np.unique(gap).tolist():
                r = by_gap.get(g)
                if r is None:
                    continue
                at = np.flatnonzero(gap == g)
                i = np.searchsorted(r[:, 1], rank[at], side="right") - 1
                hit = rank[at] < r[i, 1] + r[i, 2]
                at, i = at[hit], i[hit]
                size[at], each[at] = r[i, 3], r[i, 5]
                first[at] = r[i, 4] + (rank[at] - r[i, 1]) * r[i, 5]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gap - size * each), pa.array(size), pa.array(first), pa.array(each)], ["bin", "gap", "size", "first", "each"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """`(bin, doc_id, piece, size, start)`: every piece's bin and its offset in it.

    A document larger than `capacity` is cut into full pieces and a rest; pieces 0, 1, ... in order are the
    document. Null, zero and negative sizes have no piece. Rows that repeat an id are packed as often as they
    come; null ids are kept. Equal sizes go by id, then piece. Bins are numbered from 0 in the order in which
    they open. Other columns, of whatever name, are not read. Empty input gives an empty result.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    whole = sizes.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).cast("long").alias("n")).where("n > 0")
    cut = whole.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    cut = cut.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("size"))
    pieces = scratch.keep(_ranked(cut, parts, "size", "doc_id", "piece"))
    need, begin = _sums(pieces, "size")
    done = dict.fromkeys(need, 0)

    tables, state, opened = [], None, 0
    top = capacity
    while top >= 1:
        low = top // 2 if top * LAST > capacity else 0
        while True:
            left = {s: need[s] - done[s] for s in need if low < s <= top and need[s] > done[s]}
            if not left:
                break
            gaps, starts = state or ({}, {})
            runs = sweep(left, gaps)
            if not runs:
                n = -(-sum(s * c for s, c in left.items()) // capacity)
                new = spark.range(opened, opened + n, 1, min(parts, 1 + n // 10_000)).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap"), *[F.lit(0).cast("long").alias(c) for c in ("size", "first", "each")])
                opened += n
                rows = new if not tables else new.union(_still_open(tables[-1], need, done).select("bin", "gap", *[F.lit(0).cast("long").alias(c) for c in ("size", "first", "each")]))
            else:
                shifted = [(g, a, n, s, f + done[s], e) for g, a, n, s, f, e in runs]
                for _, _, n, s, _, e in runs:
                    done[s] += n * e
                rows = opening.select("bin", "gap", "part", "local").mapInArrow(_fill(spark.sparkContext.broadcast((shifted, starts))), _GAPS)
            tables.append(scratch.keep(_ranked(rows, parts, "gap", "bin")))
            opening = _still_open(tables[-1], need, done)
            state = _sums(opening, "gap")
        top = low
    if not tables:
        return spark.createDataFrame([], "bin long, doc_id long, piece long, size long, start long")
    placed = tables[0]
    for t in tables[1:]:
        placed = placed.union(t)
    places = placed.where("each > 0").select("bin", "size", F.explode(F.sequence("first", F.col("first") + F.col("each") - 1)).alias("rank"))
    shared = spark.sparkContext.broadcast(begin)

    def rank(it):
        for batch in it:
            r = _ranks(batch.column(3), batch.column(2), batch.column(4), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(r)], ["doc_id", "piece", "size", "rank"])

    ranked = pieces.select("doc_id", "piece", "size", "part", "local").mapInArrow(rank, "doc_id long, piece long, size long, rank long")
    order = Window.partitionBy("bin").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    both = ranked.join(places, ["size", "rank"])
    return both.select("bin", "doc_id", "piece", "size", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")).alias("start"))


def _still_open(table: DataFrame, need, done) -> DataFrame:
    """Gaps that some unplaced piece fits."""
    least = min((s for s in need if need[s] > done[s]), default=None)
    return table.where(F.lit(False) if least is None else F.col("gap") >= least)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pack` by the number of words of each text; null and word-less texts have no piece."""
    return pack(word_counts(docs), capacity)
