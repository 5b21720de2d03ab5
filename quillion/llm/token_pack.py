"""Token ids and packed binary rows (operator 3).

Texts are tokenised with a public vocabulary, split without loss into pieces of at most a row, and
packed best-fit-decreasing: pieces by falling length, each into the fullest row that still holds it. The row
is found in a segment tree over capacities in O(log row length). A shard, a hash range of the ids, is
packed by itself, so the result depends on the number of shards and not on the cluster; that number
follows from the amount of text. Rows carry ids, cumulative segment lengths and position resets.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAD = 50256
ROW = 2048
#: Characters of text to a shard, about.
SHARD_CHARS = 1 << 26
PIECE = 1 << 16


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    """All token ids of a text.

    A long text is encoded in parts that are cut before a space that follows a letter, where the pattern
    always starts a new word, so that the ids are those of the whole.
    """
    enc = encoder(path)
    if len(text) <= PIECE:
        return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32)
    parts, at = [], 0
    while at < len(text):
        stop = at + PIECE
        while 0 < stop < len(text) and not (text[stop] == " " and text[stop - 1].isalpha() and stop + 1 < len(text) and text[stop + 1].isalpha()):
            stop += 1
        parts.append(enc.encode_to_numpy(text[at:stop], allowed_special=set(), disallowed_special=()).astype(np.uint32))
        at = stop
    return np.concatenate(parts)


class Capacities:
    """Rows by capacity left, and a segment tree that finds the smallest capacity that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of `need` or more, and that capacity."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Piece numbers by row. Pieces are taken by falling length, equal ones in the order given."""
    tree, rows = Capacities(row), []
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            rows.append([i])
            at, left = len(rows) - 1, row
        else:
            at, left = got
            rows[at].append(i)
        if left > n:
            tree.put(left - n, at)
    return rows


def tokenize(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, piece, n_tokens, ids)`: pieces of at most `row` tokens, as little-endian 16- or 32-bit ids."""

    def run(it):
        small = len(encoder(vocabulary)._mergeable_ranks) < 1 << 16
        for batch in it:
            out = ([], [], [], [])

            def rows():
                return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["doc_id", "piece", "n_tokens", "ids"])

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text, vocabulary).astype("<u2" if small else "<u4")
                for p in range(0, len(ids), row):
                    part = ids[p : p + row]
                    for x, v in zip(out, (key, p // row, len(part), part.tobytes())):
                        x.append(v)
                if len(out[0]) > 4096:
                    yield rows()
                    out = ([], [], [], [])
            yield rows()

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    return some.mapInArrow(run, "doc_id long, piece int, n_tokens int, ids binary")


def _pack(row: int, pad: int, width: int):
    kind = "<u2" if width == 2 else "<u4"

    def run(batch: pa.Table) -> pa.Table:
        shard = batch.column("shard")[0].as_py()
        keys, piece, n = (np.array(batch.column(c).fill_null(-1) if batch.column(c).null_count else batch.column(c)) for c in ("doc_id", "piece", "n_tokens"))
        missing = np.array(batch.column("doc_id").is_null())
        data = batch.column("ids").to_pylist()
        order = sorted(range(len(n)), key=lambda i: (missing[i], keys[i], piece[i], data[i]))
        rows = best_fit_decreasing(n[order], row)
        out: dict[str, list] = {c: [] for c in ("row", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids")}
        for r, members in enumerate(rows):
            at = [order[i] for i in members]
            lengths = n[at]
            ids = np.full(row, pad, dtype=kind)
            position = np.zeros(row, dtype="<u2" if row <= 1 << 16 else "<u4")
            cu = np.concatenate(([0], np.cumsum(lengths)))
            for i, a, z in zip(at, cu[:-1], cu[1:]):
                ids[a:z] = np.frombuffer(data[i], kind)
                position[a:z] = np.arange(z - a)
            position[cu[-1] :] = np.arange(row - cu[-1])
            out["row"].append(r)
            out["doc_ids"].append([None if missing[i] else int(keys[i]) for i in at])
            out["pieces"].append(piece[at].tolist())
            out["cu_seqlens"].append(cu.tolist())
            out["input_ids"].append(ids.tobytes())
            out["position_ids"].append(position.tobytes())
        kinds = {"row": pa.int32(), "doc_ids": pa.list_(pa.int64()), "pieces": pa.list_(pa.int32()), "cu_seqlens": pa.list_(pa.int32()), "input_ids": pa.binary(), "position_ids": pa.binary()}
        return pa.table({"shard": pa.array([shard] * len(rows), pa.int32())} | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def pack_tokens(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY, pad: int = PAD, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows `(shard, row, doc_ids, pieces, cu_seqlens, input_ids, position_ids)`.

    `input_ids` is one row of the shard's id matrix: `row` little-endian ids, 16 bits each where the vocabulary
    allows, padded with `pad` behind the last segment. Segment j is `cu_seqlens[j]` up to `cu_seqlens[j+1]` and
    holds piece `pieces[j]` of document `doc_ids[j]`; `position_ids` start from 0 in each segment and in the padding.
    Joining a document's pieces gives all its ids. Null and empty texts have no tokens and no row. A null id
    is carried as null. Repeated rows are packed as often as they come. Ties of length go by id, piece and
    content. Other columns, of whatever name, are not read. Empty input gives an empty result.
    """
    if shards is None:
        total = docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
        shards = max(1, -(-total // SHARD_CHARS))
    width = 2 if pad < 1 << 16 else 4
    pieces = tokenize(docs, row, vocabulary, id_col, text_col)
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece"), F.lit(shards)).cast("int"))
    schema = "shard int, row int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
    return sharded.groupBy("shard").applyInArrow(_pack(row, pad, width), schema)


def write_matrices(packed: DataFrame, path: str) -> list[str]:
    """Write each shard as three `.npy`-compatible raw files below `path`, a folder that all executors share.

    `<shard>.ids` and `<shard>.pos` are row-major matrices and `<shard>.cu` the segment lengths, each row's
    ended by the row length. Files are written under a name of the attempt and renamed, so that a lost
    executor or a second attempt leaves whole files only. Returns the shards' names.
    """
    os.makedirs(path, exist_ok=True)

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        order = np.argsort(np.array(t.column("row")))
        ids, pos, cu = (t.column(c).to_pylist() for c in ("input_ids", "position_ids", "cu_seqlens"))
        files = {"ids": b"".join(ids[i] for i in order), "pos": b"".join(pos[i] for i in order), "cu": np.array([x for i in order for x in [len(cu[i]), *cu[i]]], dtype="<i4").tobytes()}
        for kind, data in files.items():
            own = os.path.join(path, f".{shard:05d}.{kind}.{os.getpid()}.{os.urandom(4).hex()}")
            with open(own, "wb") as f:
                f.write(data)
            os.replace(own, os.path.join(path, f"{shard:05d}.{kind}"))
        return pa.table({"name": [f"{shard:05d}"]})

    return sorted(r["name"] for r in packed.groupBy("shard").applyInArrow(run, "name string").collect())


__all__ = ["Capacities", "best_fit_decreasing", "encode", "pack_tokens", "tokenize", "write_matrices"]
