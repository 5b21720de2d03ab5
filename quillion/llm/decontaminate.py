"""Benchmark decontamination (operator 2).

The normalised word n-grams of the benchmark are a hash set. Windows of every training text are looked
up in it, a hit is verified word for word, and covered words are removed: as spans, or with the whole
document when they are a large part of it. The set is broadcast while its size, which is checked, allows;
beyond that a bitmap of fixed size goes out instead and its hits are verified by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import _columns, _vec

N = 8
#: Items under N words are looked up whole, if they have at least this many.
MIN_WORDS = 5
#: A document of which this share of words is covered goes as a whole.
DROP_SHARE = 0.5
#: Largest number of benchmark n-grams that are broadcast.
BROADCAST_GRAMS = 500_000
BITMAP = 27
CHARS = 1 << 19
_U = np.uint64
#: What the scan adds to columns that are numbered.
ADDED = ("words", "cut", "items")


def benchmark_grams(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct `(item_id, size, gram)`: windows of `n` words, or a shorter item whole if it has enough words."""

    def run(it):
        for batch in it:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = _vec.words([text])
                words = [_vec.fold(text[a:z]) for a, z in zip(w.start.tolist(), w.end.tolist())]
                size = min(n, len(words))
                if size >= min(n, MIN_WORDS):
                    rows += [(item, size, " ".join(words[i : i + size])) for i in range(len(words) - size + 1)]
            c = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string())], ["item_id", "size", "gram"])

    item, text = _columns.named(id_col).cast("long").alias("item_id"), _columns.named(text_col).alias("text")
    items = benchmark.select(item, text).where("text is not null and item_id is not null")
    return items.mapInArrow(run, "item_id long, size int, gram string").distinct()


def _hash(grams: list[str], n: int) -> np.ndarray:
    w = _vec.words(grams)
    bounds = np.searchsorted(w.doc, np.arange(len(grams) + 1))
    return np.array([_vec.grams(w.hash[a : a + n], n)[0] for a in bounds[:-1].tolist()], dtype=np.uint64)


class _Set:
    """Grams by size: sorted hashes, texts and item lists."""

    def __init__(self, rows: pa.Table):
        by: dict[int, dict[str, list[int]]] = {}
        for batch in rows.to_batches(max_chunksize=10_000):
            for item, size, gram in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(size, {}).setdefault(gram, []).append(item)
        self.sizes = {}
        for n, grams in by.items():
            texts = list(grams)
            h = _hash(texts, n)
            order = np.argsort(h)
            self.sizes[n] = (h[order], [texts[i] for i in order], [sorted(grams[texts[i]]) for i in order])

    def hits(self, text: str, hashes, start, end):
        """Verified windows of one text: (first word, size, items)."""
        out = []
        for n, (known, texts, items) in self.sizes.items():
            g = _vec.grams(hashes, n)
            place = np.minimum(np.searchsorted(known, g), len(known) - 1)
            for i in np.flatnonzero(known[place] == g).tolist():
                words = " ".join(_vec.fold(text[a:b]) for a, b in zip(start[i : i + n], end[i : i + n]))
                p = int(place[i])
                while p < len(known) and known[p] == g[i]:
                    if texts[p] == words:
                        out.append((i, n, items[p]))
                    p += 1
        return out


def _spans(hits, n_words: int):
    """Covered words as maximal runs [first, last]."""
    covered = np.zeros(n_words + 1, dtype=np.int64)
    for i, n, *_ in hits:
        covered[i] += 1
        covered[i + n] -= 1
    on = np.concatenate(([False], np.cumsum(covered)[:-1] > 0, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _cut(text: str, spans, start, end) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : start[a]])
        at = int(end[b])
    return "".join(parts) + text[at:]


def _any_hit(known_by_size, w, bounds):
    """Texts of a batch with at least one window whose hash is known."""
    texts = np.zeros(len(bounds) - 1, dtype=bool)
    for n, known in known_by_size.items():
        g = _vec.grams(w.hash, n)
        if not len(g):
            continue
        maybe = np.flatnonzero(known(g))
        inside = w.doc[maybe] == w.doc[maybe + n - 1]
        texts[w.doc[maybe[inside]]] = True
    return texts


def _scan(shared, text_at: int, id_at: int, chars_at: int | None):
    """Map over Arrow batches of whole documents: the same rows cleaned, without those to drop."""

    def run(it):
        grams = shared.value
        bits = {n: _bitmap(h, 22) for n, (h, _, _) in grams.sizes.items()}

        def known(n):
            h = grams.sizes[n][0]

            def f(g):
                maybe = bits[n][(g >> _U(42)).astype(np.int64)]
                at = np.flatnonzero(maybe)
                maybe[at] = h[np.minimum(np.searchsorted(h, g[at]), len(h) - 1)] == g[at]
                return maybe

            return f

        tests = {n: known(n) for n in grams.sizes}
        for batch in it:
            texts = batch.column(text_at).to_pylist()
            m = len(texts)
            keep, changed = np.ones(m, dtype=bool), {}
            n_words, n_cut, items = np.zeros(m, np.int64), np.zeros(m, np.int64), [""] * m
            whole = [t or "" for t in texts]
            for a, b in _vec.slices([len(t) for t in whole], CHARS):
                w = _vec.words(whole[a:b])
                bounds = np.searchsorted(w.doc, np.arange(b - a + 1))
                n_words[a:b] = np.diff(bounds)
                for i in np.flatnonzero(_any_hit(tests, w, bounds)).tolist():
                    s = slice(int(bounds[i]), int(bounds[i + 1]))
                    text = whole[a + i]
                    hits = grams.hits(text, w.hash[s], w.start[s], w.end[s])
                    if hits:
                        spans = _spans(hits, s.stop - s.start)
                        cut = sum(y - x + 1 for x, y in spans)
                        keep[a + i] = cut < DROP_SHARE * (s.stop - s.start)
                        n_cut[a + i] = cut
                        items[a + i] = ",".join(map(str, sorted({x for h in hits for x in h[2]})))
                        changed[a + i] = _cut(text, spans, w.start[s], w.end[s])
            columns = list(batch.columns)
            if changed:
                for i, t in changed.items():
                    texts[i] = t
                columns[text_at] = pa.array(texts, batch.column(text_at).type)
            if chars_at is not None and changed:
                n = columns[chars_at].to_pylist()
                for i, t in changed.items():
                    n[i] = len(t)
                columns[chars_at] = pa.array(n, columns[chars_at].type)
            out = pa.RecordBatch.from_arrays(columns + [pa.array(n_words), pa.array(n_cut), pa.array(items)], names=[*batch.schema.names, *ADDED])
            yield out if keep.all() else out.filter(pa.array(keep))
        _vec.trim()

    return run


def _bitmap(hashes, bits: int):
    table = np.zeros(1 << bits, dtype=bool)
    table[(hashes >> _U(64 - bits)).astype(np.int64)] = True
    return table


def _find(shared, sizes):
    """Windows that may be in the set, by a bitmap only: (key, first, size, gram)."""

    def run(it):
        table = np.unpackbits(shared.value, bitorder="little").view(bool)
        for batch in it:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _vec.slices([len(t) for t in texts], CHARS):
                w = _vec.words(texts[a:b])
                rows = []
                for n in sizes:
                    g = _vec.grams(w.hash, n)
                    at = np.flatnonzero(table[(g >> _U(64 - BITMAP)).astype(np.int64)])
                    first = np.searchsorted(w.doc, w.doc[at])
                    for i, f in zip(at.tolist(), first.tolist()):
                        if w.doc[i] == w.doc[i + n - 1]:
                            t = texts[a + w.doc[i]]
                            rows.append((keys[a + w.doc[i]], i - f, n, " ".join(_vec.fold(t[x:y]) for x, y in zip(w.start[i : i + n], w.end[i : i + n]))))
                c = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string())], ["key", "first", "size", "gram"])

    return run


def _apply(text_at: int, hits_at: int, chars_at: int | None):
    """Cleaning with hits that a join has verified."""

    def run(it):
        for batch in it:
            texts, found = batch.column(text_at).to_pylist(), batch.column(hits_at).to_pylist()
            m = len(texts)
            keep = np.ones(m, dtype=bool)
            n_words, n_cut, items = [0] * m, [0] * m, [""] * m
            for i, (t, hits) in enumerate(zip(texts, found)):
                w = _vec.words([t or ""])
                n_words[i] = len(w.hash)
                if hits:
                    spans = _spans([(h["first"], h["size"]) for h in hits], n_words[i])
                    n_cut[i] = sum(y - x + 1 for x, y in spans)
                    keep[i] = n_cut[i] < DROP_SHARE * n_words[i]
                    items[i] = ",".join(map(str, sorted({h["item_id"] for h in hits})))
                    texts[i] = _cut(t, spans, w.start, w.end)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.column(text_at).type)
            if chars_at is not None:
                old = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([len(texts[i]) if n_cut[i] else old[i] for i in range(m)], columns[chars_at].type)
            columns = [c for j, c in enumerate(columns) if j not in (hits_at, hits_at - 1)]
            names = [x for j, x in enumerate(batch.schema.names) if j not in (hits_at, hits_at - 1)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n_words, pa.int64()), pa.array(n_cut, pa.int64()), pa.array(items, pa.string())], names=[*names, *ADDED]).filter(pa.array(keep))

    return run


def _bits_of(grams: DataFrame) -> np.ndarray:
    """The bitmap of the grams' hashes, packed, low bits first; built in the executors in rows of 4 KB."""

    def used(it):
        for batch in it:
            for s in range(0, batch.num_rows, 50_000):
                part = batch.slice(s, 50_000).to_pydict()
                at = [_hash([g], z)[0] for g, z in zip(part["gram"], part["size"])]
                yield pa.RecordBatch.from_arrays([pa.array((np.array(at, dtype=np.uint64) >> _U(64 - BITMAP)).astype(np.int64) + 1)], ["bit"])

    rows = grams.select("size", "gram").mapInArrow(used, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(1 << (BITMAP - 3), dtype=np.uint8)
    for r in rows.toLocalIterator():  # at most 2^BITMAP / 32768 rows
        at = (r["bucket"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def _decontaminated(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_grams: int) -> DataFrame:
    """`docs` cleaned, its columns numbered, with those of `ADDED`."""
    spark = docs.sparkSession
    grams = benchmark_grams(benchmark, n)
    own = _columns.numbered(docs)
    schema = T.StructType([*own.schema.fields, *[T.StructField(c, t) for c, t in zip(ADDED, (T.LongType(), T.LongType(), T.StringType()))]])
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    few = grams.limit(broadcast_grams + 1).toArrow()
    if few.num_rows <= broadcast_grams:
        return own.mapInArrow(_scan(spark.sparkContext.broadcast(_Set(few)), text_at, 0, chars_at), schema)
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())
    keyed = own.withColumn("key", F.sha2(F.to_json(F.struct(*own.columns)), 256))
    maybe = keyed.select("key", f"c{text_at}").mapInArrow(_find(spark.sparkContext.broadcast(_bits_of(grams)), sizes), "key string, first int, size int, gram string")
    hits = maybe.distinct().join(grams, ["size", "gram"]).groupBy("key").agg(F.collect_set(F.struct("first", "size", "item_id")).alias("hits"))
    joined = keyed.join(hits, "key", "left").select(*own.columns, "key", "hits")
    return joined.mapInArrow(_apply(text_at, len(own.columns) + 1, chars_at), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """`docs` without benchmark passages: covered words cut out, mostly covered documents dropped.

    A passage is `n` words in a row, as normalised, that a benchmark item has too; an item of `MIN_WORDS`
    to `n`-1 words counts whole, one of fewer is no evidence. What is cut runs from the first covered word to
    the last of each run. Documents with no text, or null text, stay as they are, and so do columns of any
    name, save `text` and `n_chars` of changed rows. Each row is handled by itself, so that
    repeated rows and null ids need no care. With an empty benchmark nothing changes.
    """
    return _decontaminated(docs, benchmark, n, broadcast_grams).drop(*ADDED).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """`(doc_id, text, n_words, n_removed, items)` of the documents that stay; `items` lists benchmark ids."""
    out = _decontaminated(docs.select("doc_id", "text"), benchmark, n, broadcast_grams)
    return out.toDF("doc_id", "text", "n_words", "n_removed", "items")
