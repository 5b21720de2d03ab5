"""Shingle postings by shingle, in packed rows: arrays of hashes and places in place of a row for each.

Rows `(id, grams)` are numbered sets of 64-bit hashes. `by_gram` brings all postings of a hash into one partition for 10 bytes each;
what is asked about hashes is then counted with arrays, and only the answer is rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm import _vec
from quillion.plans.scratch import Scratch, arrow_rows, no_old_shuffles

#: Postings of a part, about, and postings and documents that are packed at once.
PART = 4_000_000
PACK, DOCS = 1_000_000, 65_000
#: Blocks in one side of a cell at most, and shingles of a cell that have a bitmap of its blocks.
SIDE, DENSE = 1 << 17, 4096
#: Pairs that are listed at once, about.
PAIRS = 2_000_000
_U = np.uint64
_DOC = np.dtype([("id", "<i8"), ("n", "<u4")])


def sets_of(batch):
    """Ids of a batch, and their sets as one array with its bounds; without rows that have no id or set."""
    ids, grams = batch.column(0), batch.column(1)
    at, flat = grams.offsets.to_numpy(), grams.values.to_numpy(zero_copy_only=False).view(np.uint64)
    known = np.array(ids.is_valid()) & (np.diff(at) > 0)
    size = np.diff(at)[known]
    own = np.repeat(at[:-1][known] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    return ids.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), size, flat[own]


def _pack(parts: int):
    def run(it):
        held, total, many = [], 0, 0

        def flush():
            size = np.concatenate([n for _, n, _ in held])
            docs = np.zeros(len(size), dtype=_DOC)
            docs["id"], docs["n"] = np.concatenate([i for i, _, _ in held]), size
            who = np.repeat(np.arange(len(docs), dtype=np.uint32), size)
            gram = np.concatenate([g for *_, g in held])
            part = ((gram >> _U(32)) % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[p] : cuts[p + 1]]
                w = who[mine]  # ascending, as the order is stable
                first = np.concatenate(([True], w[1:] != w[:-1]))
                rows.append((p, docs[w[first]].tobytes(), gram[mine].tobytes(), (np.cumsum(first) - 1).astype(np.uint16).tobytes()))
            for i in range(0, len(rows), 16):
                some = list(zip(*rows[i : i + 16]))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), *(pa.array(x, pa.binary()) for x in some[1:])], ["part", "docs", "grams", "places"])

        for batch in it:
            ids, size, flat = sets_of(batch)
            if held and (many + len(ids) > DOCS or total + len(flat) > PACK):
                yield from flush()
                held, total, many = [], 0, 0
            held.append((ids, size, flat))
            total += len(flat)
            many += len(ids)
        if held:
            yield from flush()
        del held
        _vec.trim()

    return run


def _parts(it):
    """Of each part: its documents' ids and sizes, hashes in order with the place of each one's document, and where each hash begins."""
    by_part: dict[int, list] = {}
    for batch in it:
        for p, d, g, w in zip(*(c.to_pylist() for c in batch.columns)):
            by_part.setdefault(p, []).append((np.frombuffer(d, _DOC), np.frombuffer(g, np.uint64), np.frombuffer(w, np.uint16)))
    while by_part:
        blobs = by_part.popitem()[1]
        docs = np.concatenate([d for d, _, _ in blobs])
        shift = np.concatenate(([0], np.cumsum([len(d) for d, _, _ in blobs])[:-1]))
        gram = np.concatenate([g for _, g, _ in blobs])
        who = np.concatenate([w.astype(np.int32) + np.int32(x) for (_, _, w), x in zip(blobs, shift)])
        del blobs
        order = np.argsort(gram, kind="stable")
        gram, who = gram[order], who[order]
        del order
        yield docs, gram, who, np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
    _vec.trim()


def _number_of_parts(rows: DataFrame) -> int:
    total = rows.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))


def by_gram(rows: DataFrame, answer, schema: str) -> DataFrame:
    """What `answer(docs, gram, who, cut)` yields as batches of `schema` for each part of the postings of written `rows(id, grams)`."""

    def run(it):
        for part in _parts(it):
            yield from answer(*part)

    parts = _number_of_parts(rows)
    packed = rows.select("id", "grams").mapInArrow(_pack(parts), "part int, docs binary, grams binary, places binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def _cell(i: int, j: int, sides: int) -> int:
    """Number of a cell, `i <= j < sides`."""
    return i * sides - i * (i - 1) // 2 + j - i


def _to_cells(offset: np.ndarray, side: int, sides: int):
    """Postings of hashes of several blocks, in every cell of two sides of numbers that has some on both; a hash comes once, with all its numbers on each side."""

    def answer(docs, gram, who, cut):
        ids = docs["id"]
        number = offset[ids >> 33] + (ids & ((1 << 33) - 1))
        df = np.diff(cut)
        many = np.repeat(df > 1, df)
        gram, x = gram[many], number[who[many]]
        order = np.lexsort((x, gram))
        gram, x = gram[order], x[order]
        s = x // side
        # runs of one hash on one side, and the runs of its other sides
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (s[1:] != s[:-1]))) if len(gram) else np.zeros(0, bool)
        at = np.append(np.flatnonzero(new), len(gram))
        g, of, n = gram[at[:-1]], s[at[:-1]], np.diff(at)
        held: dict[tuple[int, int], list] = {}

        def send(i, j, run):
            """Runs `run` to cells `i, j`."""
            cell = i.astype(np.int64) << 32 | j
            order = np.argsort(cell, kind="stable")
            cell, run = cell[order], run[order]
            ends = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell)) if len(cell) else [0]
            for a, z in zip(ends[:-1], ends[1:]):
                some = run[a:z]
                where = np.repeat(at[:-1][some] - np.concatenate(([0], np.cumsum(n[some])[:-1])), n[some]) + np.arange(int(n[some].sum()))
                held.setdefault((int(cell[a] >> 32), int(cell[a] & 0xFFFFFFFF)), []).append((g[some].tobytes(), n[some].astype(np.uint32).tobytes(), x[where].astype(np.uint32).tobytes()))

        own = np.flatnonzero(n > 1)
        send(of[own], of[own], own)
        where, step = np.arange(len(g)), 1
        while True:
            where = where[where + step < len(g)]
            where = where[g[where] == g[where + step]]
            if not len(where):
                break
            for run in (where, where + step):
                send(of[where], of[where + step], run)
            step += 1
        for (i, j), blobs in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([_cell(i, j, sides)], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), *(pa.array([b"".join(b)], pa.binary()) for b in zip(*blobs))], ["cell", "i", "j", "grams", "sizes", "numbers"])

    return answer


def _shared(gram, size, x, i, j, side):
    """Pairs `l < r` of numbers of sides `i` and `j` that have a hash in common, from runs of numbers: one of each hash and side."""
    begin = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[:-1]
    on = x[begin] // np.uint32(side)
    _, which = np.unique(gram, return_inverse=True)
    grams = int(which.max()) + 1
    runs = [np.full(grams, -1), np.full(grams, -1)]
    for k, s in enumerate((i, j)):
        runs[k][which[on == s]] = np.flatnonzero(on == s)
    left, right = (r[(runs[0] >= 0) & (runs[1] >= 0)] for r in runs)
    nl, nr, begin_l, begin_r = size[left].astype(np.int64), size[right].astype(np.int64), begin[left], begin[right]
    del which, on, runs
    dense = np.argsort(-(nl * nr), kind="stable")[:DENSE]
    dense = dense[(nr[dense] >= 64) & (nl[dense] > 1)]
    words = -(-side // 64)
    row = np.full(len(nl), -1, dtype=np.int32)
    row[dense] = np.arange(len(dense))
    bits = np.zeros((len(dense), words), dtype=np.uint64)
    for k, d in enumerate(dense.tolist()):
        has = np.zeros(words * 64, dtype=bool)
        has[x[begin_r[d] : begin_r[d] + nr[d]] - np.uint32(j * side)] = True
        bits[k] = np.packbits(has, bitorder="little").view(np.uint64)
    # hashes of each left number, dense ones apart
    gl = np.repeat(np.arange(len(nl), dtype=np.int32), nl)
    l = np.repeat(begin_l - np.concatenate(([0], np.cumsum(nl)[:-1])), nl)  # noqa: E741
    l += np.arange(len(l))
    l = (x[l] - np.uint32(i * side)).astype(np.int32)  # noqa: E741
    order = np.argsort(l, kind="stable")
    gl, l = gl[order], l[order]  # noqa: E741
    some = row[gl] >= 0
    dl, dg = l[some], row[gl[some]]
    gl, l = gl[~some], l[~some]  # noqa: E741
    del order, some
    upto = np.concatenate(([0], np.cumsum(nr[gl])))
    total, at = 0, 0
    chunks = np.arange(0, side + 64, 64)
    d_cut, l_cut = np.searchsorted(dl, chunks), np.searchsorted(l, chunks)
    keys, first = np.zeros(0, np.int64), 0
    for c in range(len(chunks) - 1):
        if c >= first:  # list pairs of as many chunks as fit
            until = c + 1
            while until < len(chunks) - 1 and upto[l_cut[until + 1]] - upto[l_cut[c]] <= PAIRS:
                until += 1
            a, z = l_cut[c], l_cut[until]
            many = nr[gl[a:z]]
            y = x[np.repeat(begin_r[gl[a:z]] - (upto[a:z] - upto[a]), many) + np.arange(int(many.sum()))] - np.uint32(j * side)
            keys = (np.repeat(l[a:z].astype(np.int64), many) << 32) + y
            if i == j:
                keys = keys[keys >> 32 < keys & 0xFFFFFFFF]
            keys, first = np.unique(keys), until
            k_cut = np.searchsorted(keys, chunks[c : until + 1] << 32)
            at = c
        a, z = k_cut[c - at], k_cut[c - at + 1]
        p, q = d_cut[c], d_cut[c + 1]
        if p == q:
            total += int(z - a)
            continue
        start = np.flatnonzero(np.concatenate(([True], dl[p + 1 : q] != dl[p : q - 1])))
        who = dl[p:q][start] - chunks[c]
        near = np.zeros((64, words), dtype=np.uint64)
        ends = np.append(start, q - p)
        step = max(1, (1 << 21) // words)  # rows of bits that are gathered at once
        s = 0
        while s < len(start):
            e = max(s + 1, int(np.searchsorted(ends, ends[s] + step, side="right")) - 1)
            near[who[s:e]] = np.bitwise_or.reduceat(bits[dg[p + ends[s] : p + ends[e]]], start[s:e] - start[s], axis=0)
            s = e
        if i == j:
            near[:, :c] = 0
            near[:, c] &= ~((_U(2) << np.arange(64, dtype=np.uint64)) - _U(1))
        total += int(np.bitwise_count(near).sum(dtype=np.int64))
        if z > a:
            u, v = (keys[a:z] >> 32) - chunks[c], keys[a:z] & 0xFFFFFFFF
            total += int(z - a) - int(((near[u, v >> 6] >> (v & 63).astype(np.uint64)) & _U(1)).sum())
    return total


def _count_cells(side: int):
    def run(it):
        held: dict[tuple[int, int], list] = {}
        for batch in it:
            for _, i, j, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((i, j), []).append([np.frombuffer(b, t) for b, t in zip(blob, (np.uint64, np.uint32, np.uint32))])
        while held:
            (i, j), blobs = held.popitem()
            gram, size, x = (np.concatenate(b) for b in zip(*blobs))
            del blobs
            yield pa.RecordBatch.from_arrays([pa.array([_shared(gram, size, x, i, j, side)], pa.int64())], ["pairs"])
            del gram, size, x
        _vec.trim()

    return run


def sharing_pairs(rows: DataFrame) -> DataFrame:
    """`(pairs)`: the number of pairs of rows that have a hash in common, exactly; `rows(id, grams)` as written with `monotonically_increasing_id`.

    The pairs are as many as the square of the rows, and so is the work, but no pair leaves its task: a cell has the postings of two sides of
    at most `SIDE` rows, marks what each row meets in bits, by the word where hashes are common, and counts the bits.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharing")
    with arrow_rows(spark, 1000), no_old_shuffles(spark):
        counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("id", 33).alias("p")).count().collect())
        offset = np.zeros(max((p for p, _ in counts), default=0) + 1, dtype=np.int64)
        total = 0
        for p, n in counts:
            offset[p], total = total, total + n
        sides = max(-(-total // SIDE), min(int((4 * spark.sparkContext.defaultParallelism) ** 0.5) + 1, total // 2048), 1)
        side = max(64, -(-total // sides // 64) * 64)
        side += 64 * (side * sides < total)
        cells = by_gram(rows, _to_cells(offset, side, sides), "cell int, i int, j int, grams binary, sizes binary, numbers binary")
        counted = cells.repartitionById(max(1, sides * (sides + 1) // 2), F.col("cell")).mapInArrow(_count_cells(side), "pairs long")
        return scratch.keep(counted.agg(F.coalesce(F.sum("pairs"), F.lit(0).cast("long")).alias("pairs")))


def _rare_pairs(most: int, least: float, parts: int, copies):
    """Pairs of documents that share a hash of at most `most`, packed by the smaller id, and how many commoner ones each document has."""

    def packed(l, n, h, count, r, shared):  # noqa: E741
        """Rows of pairs that are sorted by `l`, which has each id once."""
        part = (_vec.mix(l.view(np.uint64)) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        begin = np.concatenate(([0], np.cumsum(count)))
        ends = np.append(np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))), len(order))
        rows = []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
            some = order[a:z]
            where = np.repeat(begin[some] - np.concatenate(([0], np.cumsum(count[some])[:-1])), count[some]) + np.arange(int(count[some].sum()))
            rows.append((int(part[some[0]]), *(x.tobytes() for x in (l[some], n[some], h[some], count[some].astype(np.uint32), r[where], shared[where]))))
        for i in range(0, len(rows), 16):
            some = list(zip(*rows[i : i + 16]))
            yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), *(pa.array(x, pa.binary()) for x in some[1:])], ["part", "l", "n", "h", "count", "r", "shared"])

    def answer(docs, gram, who, cut):
        ids, first, rank = np.unique(docs["id"], return_index=True, return_inverse=True)
        size = docs["n"][first]
        rank = rank.astype(np.int32)[who]
        df = np.diff(cut)
        if least:
            h = np.bincount(rank[np.repeat(df > most, df)], minlength=len(ids)).astype(np.uint32)
            some = np.flatnonzero(h)
            none = np.zeros(len(some), np.int64)
            if len(some):
                yield from packed(ids[some], size[some], h[some], none, np.zeros(0, np.int64), np.zeros(0, np.uint16))
        known, text = copies.value
        place = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
        text = np.where(known[place] == ids, text[place], np.int64(-1)) if len(known) else np.full(len(ids), -1)
        rare = np.flatnonzero((df > 1) & (df <= most))
        slices = np.cumsum(df[rare] * (df[rare] - 1) // 2) // PAIRS
        for s in np.unique(slices).tolist():
            run = rare[slices == s]
            n = df[run]
            at = np.repeat(cut[run] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            end = np.repeat(cut[run] + n, n)
            keys = []
            for step in range(1, int(n.max())):
                at, end = at[at + step < end], end[at + step < end]
                a, b = rank[at], rank[at + step]
                ok = (a != b) & ((text[a] != text[b]) | (text[a] == -1))
                if least:
                    ok &= np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
                a, b = a[ok].astype(np.int64), b[ok].astype(np.int64)
                keys.append(np.minimum(a, b) << 32 | np.maximum(a, b))
            both, shared = np.unique(np.concatenate(keys), return_counts=True)
            if len(both):
                l, count = np.unique(both >> 32, return_counts=True)  # noqa: E741
                yield from packed(ids[l], size[l], np.zeros(len(l), np.uint32), count, ids[both & 0xFFFFFFFF], np.minimum(shared, 65535).astype(np.uint16))

    return answer


def _gathered(least: float):
    """Of each document the partners with a larger id, each once; with `least`, those that may have that Jaccard, as pairs."""
    kinds = (np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.uint16)

    def run(it):
        by_part: dict[int, list] = {}
        for batch in it:
            for p, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                by_part.setdefault(p, []).append([np.frombuffer(b, k) for b, k in zip(blob, kinds)])
        while by_part:
            l, n, h, count, r, shared = (np.concatenate(x) for x in zip(*by_part.popitem()[1]))  # noqa: E741
            ids, first, place = np.unique(l, return_index=True, return_inverse=True)
            size, common = n[first], np.bincount(place, weights=h)
            who = np.repeat(place.astype(np.int32), count)
            order = np.lexsort((r, who))
            who, r, shared = who[order], r[order], shared[order]
            at = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (r[1:] != r[:-1])))) if len(r) else np.zeros(0, np.int64)
            if not len(at):
                continue
            i = np.add.reduceat(shared.astype(np.int64), at)
            who, r = who[at], r[at]
            if least:  # what two sets share is `least` of the larger one or more
                ok = i + common[who] >= least * size[who] - 1e-6
                a, b = ids[who[ok]], r[ok]
                for s in range(0, len(a), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(a[s : s + (1 << 17)]), pa.array(b[s : s + (1 << 17)])], ["a", "b"])
                continue
            begin = np.append(np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))), len(who))
            for s in range(0, len(begin) - 1, 1000):
                some = range(s, min(s + 1000, len(begin) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[who[begin[s : s + len(some)]]]), pa.array(np.diff(begin[s : s + len(some) + 1])), pa.array([r[begin[k] : begin[k + 1]].tobytes() for k in some], pa.binary())], ["l", "n", "partners"])
        _vec.trim()

    return run


def rare_partners(rows: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """Pairs of different texts that share a hash of at most `most` rows, of written `rows(id, t, grams)` with the text's digest `t`; each pair once.

    `(l, n, partners)`: each id with its `n` partners of larger ids, ascending, as bytes of longs. With `least`, `(a, b)`, `a < b`: a superset of
    the pairs that have that Jaccard. Pairs grow with the postings, as a hash has `most - 1` partners at most. Ids of texts that are there more
    than once are broadcast, 16 bytes each.
    """
    spark = rows.sparkSession
    with arrow_rows(spark, 1000), no_old_shuffles(spark):
        text = rows.where("t is not null").groupBy("t").agg(F.min("id").alias("text"), F.count("*").alias("c")).where("c > 1")
        same = rows.select("id", "t").join(text, "t").select("id", "text").distinct().toPandas().sort_values("id")
        copies = spark.sparkContext.broadcast((same["id"].to_numpy(np.int64), same["text"].to_numpy(np.int64)))
        parts = _number_of_parts(rows)
        packed = by_gram(rows, _rare_pairs(most, least, parts, copies), "part int, l binary, n binary, h binary, count binary, r binary, shared binary")
        found = packed.repartitionById(parts, F.col("part")).mapInArrow(_gathered(least), "a long, b long" if least else "l long, n long, partners binary")
        return Scratch(spark, "partners").keep(found)
