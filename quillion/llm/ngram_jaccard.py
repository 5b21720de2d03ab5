"""N-gram Jaccard join by parity sketches (operator 10).

Every text is the set of its distinct word n-grams. Two sets with Jaccard of `threshold` or more
differ in at most k grams, where k follows from their sizes. Sizes are cut into bands with the ratio
1/threshold, so that a partner is in the same band or the next. In a band, grams are hashed to b blocks
and each block is a parity sketch: the XOR of the hashes of its grams. A differing gram changes one
block, so the number of differing blocks is a lower bound of the symmetric difference, and at most k
blocks differ. By the pigeonhole principle the first k+c blocks that hold an informative gram contain
c that both sets share. Those sketches are joined on equality, pairs with fewer than c in common are
dropped, so are those whose sketches of the whole sets differ in too many bits, and the rest is
verified exactly. Where a band has several parts, c is more than their number, so that a pair has two or more in
common in one of them, and the pairs that have one in a part need not leave it.

Grams that many documents have (`hot`) make a block uninformative when it holds nothing else. Which
grams are hot changes the work only: a set with too few informative blocks (`weak`) falls back to
single grams, rare ones first, which finds pairs of two weak sets; other pairs are found by the strong
one. No candidate is dropped by a cap.

Pairs inside a large family of near copies are not joined: documents that share one of their least gram hashes with
many others, and whose sketch is like that of the first of them, are one `family`, and all pairs of a family are
compared, in cells of bounded size that give sums and a forest, not pairs. The join skips pairs inside a family and finds
all others, so which documents are in a family changes the work only.

Documents with equal sets are one node. The operator's result has one row for each document, with its class and
its number of links, so that it grows with the documents and not with the square of a family.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm import _columns, _vec
from quillion.operators.components import connected_components
from quillion.plans.scratch import Scratch, arrow_rows, no_old_shuffles

N = 2
THRESHOLD = 0.7
CHARS = 1 << 20
COMMON = 4
#: Sketches that are joined in one part, about.
PART = 6_000_000
#: Sketches that are sorted at once.
SLICE = 500_000
#: Members of runs whose pairs are listed at once, about.
BLOCK = 400_000
#: Pairs that one pass over a part counts, about.
PAIRS = 1_500_000
#: Bytes of the cells that are verified at once, about; a cell is never split.
CELLS = 8 << 20
#: Least number of documents of a family, and of those that share the hash that it is found by.
FAMILY = 100
#: Least gram hashes of a set that its family is found by.
KEYS = 4
#: Share of the bits in which sketches of unrelated sets differ that members of a family may differ in.
ALIKE = 0.75
#: Documents and grams of one side of a cell of a family, about.
CHUNK_DOCS = 2048
CHUNK_GRAMS = 800_000
HOT_MAX = 1 << 21
FILTER_MAX = 1 << 22
_U = np.uint64
_DOC = np.dtype([("id", "<i8"), ("h", "<u8"), ("n", "<u4"), ("f", "<u4")])


class Bands:
    """Size bands for a threshold: bounds, largest symmetric difference and number of blocks."""

    def __init__(self, threshold: float):
        t = Fraction(str(threshold))
        if not Fraction(13, 20) <= t <= 1:
            raise ValueError("the threshold must be from 0.65 to 1")
        self.t = t
        lo, k, b = [1], [], []
        if t == 1:  # equal sets only, which need no sketch
            lo, k, b = [1, 1 << 40], [0], [1]
        while lo[-1] < 1 << 40:
            most = int(lo[-1] / t)
            lo.append(most + 1)
            k.append(int((1 - t) / (1 + t) * (most + int(most / t))))
            b.append(1 if k[-1] == 0 else int(2.5 * k[-1]) + 2)
        self.lo, self.k, self.b = (np.array(x, dtype=np.int64) for x in (lo, k, b))
        #: Sketches that a pair has in common at least, and how many of a set are joined.
        self.common = np.maximum(1, np.minimum(COMMON, self.lo[:-1] - self.k))
        self.joined = self.k + self.common

    def of(self, n):
        return np.searchsorted(self.lo, n, side="right") - 1

    def _work(self, sizes, joined):
        """Sketches of each band."""
        work = np.zeros(len(self.k))
        for n, count in sizes.items():
            i = int(self.of(n))
            work[i] += count * min(n, int(joined[i]))
            if i:
                work[i - 1] += count * min(n, int(joined[i - 1]))
        return work

    def shared(self, number: np.ndarray) -> np.ndarray:
        """Sketches that a pair is asked to have in common, for `number` parts of each band: more than parts, if that asks for few more."""
        more = number + COMMON - 1
        return np.where((number > 1) & (more <= self.k // 8) & (more <= self.lo[:-1] - self.k), more, self.common)

    def asked(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each band the most that a pair may have in common in a part and stay there, and how many it needs beyond those.

        A pair with `shared` in common, in `number` parts, has `need` or more left where `most` are taken from what each part has.
        """
        common, number = self.shared(number), np.maximum(number, 1)
        most = (common - 1) // number
        most = np.where((most == 1) & (common - number < 2), 0, most)  # one beyond would be asked of too many pairs
        return most, common - most * number

    def routes(self, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """First part and number of parts of each band, of about `PART` sketches each; `sizes` counts sets by size."""
        number = np.zeros(len(self.k), dtype=np.int64)
        for _ in range(3):  # more parts ask for more sketches
            work = self._work(sizes, self.k + self.shared(number))
            number = np.ceil(work / PART).astype(np.int64)
        # sizes are rounded here but not where sketches are sent: a band beside an occupied one may get some too
        beside = np.zeros(len(work), dtype=bool)
        beside[1:] |= work[:-1] > 0
        beside[:-1] |= work[1:] > 0
        number[beside] = np.maximum(number[beside], 1)
        return np.cumsum(number) - number, number

    def similar_sizes(self, a, b):
        return np.minimum(a, b) * self.t.denominator >= np.maximum(a, b) * self.t.numerator

    def enough(self, inter, a, b):
        return inter * self.t.denominator >= (a + b - inter) * self.t.numerator


def _rows(batch, empty=False):
    """Ids and texts of a batch, or sets of hashes in place of texts; rows without an id are left out, and those without a text unless `empty` asks for them."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    if pa.types.is_list(texts.type):
        at, flat = texts.offsets.to_numpy(), texts.values.to_numpy(zero_copy_only=False).view(np.uint64)
        return zip(*[(i, flat[a:z]) for i, a, z in zip(ids, at[:-1].tolist(), at[1:].tolist()) if i is not None and (z > a or empty)]) if ids else ()
    texts = texts.to_pylist()
    return zip(*[(i, t or "") for i, t in zip(ids, texts) if i is not None and (t or empty)]) if ids else ()


def _batches(it, limit=CHARS, empty=False):
    for batch in it:
        got = tuple(_rows(batch, empty))
        if got:
            ids, texts = got
            for a, b in _vec.slices(_lengths(texts), limit):
                yield np.array(ids[a:b], dtype=np.int64), list(texts[a:b])


def _lengths(texts):
    """Characters of texts; a gram of a given set counts as a word of a text."""
    return [len(t) * (8 if isinstance(t, np.ndarray) else 1) for t in texts]


def _gram_sets(texts, n):
    """Sorted distinct grams of each text, or given ones in that order."""
    return [np.unique(t) for t in texts] if n is None else _vec.gram_sets(texts, n)


def _join_sets(sets):
    n = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), n


def _set_hashes(flat, n):
    """Two independent 64-bit hashes of each non-empty set."""
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    h1 = _vec.mix(np.add.reduceat(_vec.mix(flat ^ _U(0xA5A5)), at) + n.astype(np.uint64))
    h2 = _vec.mix(np.bitwise_xor.reduceat(_vec.mix(flat * _U(0x9FB21C651E98DF25)), at))
    return h1, h2


def _least(flat, n):
    """The least of each set's gram hashes under each of `KEYS` mixes, set by set."""
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    return np.stack([np.minimum.reduceat(_vec.mix(flat ^ _U(0x9E3779B9 * (i + 1))), at) for i in range(KEYS)], axis=1)


def _described(ids, h1, h2, n, sketch, keys=None):
    if keys is None:
        keys = pa.nulls(len(ids), pa.list_(pa.int64()))
    else:
        keys = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * np.int32(keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), keys], ["doc_id", "h1", "h2", "n", "sketch", "keys"])


def _non_empty(ids, sets):
    keep = [i for i, s in enumerate(sets) if len(s)]
    return ids[keep], [sets[i] for i in keep]


def _bits(n):
    """Bits of a set's parity sketch: the power of two of at least two bits a gram, 64 at least."""
    return 1 << max(6, int(2 * n - 1).bit_length())


def _sketch(grams):
    """Parity sketch of a set: every gram flips the bit at its hash modulo the number of bits."""
    bits = _bits(len(grams))
    flips = np.bincount((_vec.mix(grams ^ _U(0x5BD1E995)) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(bool)).tobytes()


def _summarise(n, per_doc_hot):
    """Set hash, size and sketch of each document, and, without an id, counts of grams that are common in this part."""

    def run(it):
        held, docs = [], 0

        def counts():
            grams, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(2, int(per_doc_hot * docs / 4))
            m = int(keep.sum())
            return _described([None] * m, grams[keep].view(np.int64), [None] * m, c[keep], [None] * m)

        for ids, texts in _batches(it, empty=True):
            every = ids
            ids, sets = _non_empty(ids, _gram_sets(texts, n))
            bare = np.setdiff1d(every, ids)
            if len(bare):
                yield _described(bare, np.zeros_like(bare), np.zeros_like(bare), np.zeros_like(bare), [None] * len(bare))
            if not sets:
                continue
            flat, size = _join_sets(sets)
            h1, h2 = _set_hashes(flat, size)
            yield _described(ids, h1.view(np.int64), h2.view(np.int64), size, [_sketch(s) for s in sets], _least(flat, size))
            held.append(flat)
            docs += len(ids)
            if sum(map(len, held)) > 1 << 21:
                yield counts()
                held, docs = [], 0
        if held:
            yield counts()
        del held
        _vec.trim()

    return run


def _signatures(flat, size, bands: Bands, hot, many):
    """Block sketches of a batch of sets, `many` of a set by band: (sketch, set number, whether for the band below its own, band)."""
    level = bands.of(size)
    number = np.repeat(np.arange(len(size)), size)
    common = hot[(flat >> _U(40)).astype(np.int64)]
    rare = common == 0
    second = _vec.mix(flat * _U(0xD1342543DE82EF95))
    top = flat >> _U(32)
    starts = np.concatenate(([0], np.cumsum(size)))
    out = []
    for below in (0, 1):
        lv = level - below
        ok = lv >= 0
        lv = np.maximum(lv, 0)
        b, joined = bands.b[lv], many[lv]
        block = ((top * b[number].astype(np.uint64)) >> _U(32)).astype(np.int64)
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (block[1:] != block[:-1]) | (number[1:] != number[:-1])
        at = np.flatnonzero(first)
        sketch = np.bitwise_xor.reduceat(second, at)
        informative = np.logical_or.reduceat(rare, at)
        whose, which = number[at], block[at]
        seen = np.cumsum(informative)
        before = np.zeros(len(size) + 1, dtype=np.int64)
        np.add.at(before, whose + 1, informative)
        useful = before[1:].copy()
        before = np.cumsum(before)
        keep = informative & (seen - before[whose] <= joined[whose]) & ok[whose]
        whose, salt = whose[keep], (lv[whose[keep]] << 32) + which[keep]
        out.append((_vec.mix(sketch[keep] ^ _vec.mix(salt.astype(np.uint64))), whose, below, lv[whose]))
        for i in np.flatnonzero(ok & (useful < joined)):
            a, z = starts[i], starts[i + 1]
            order = np.argsort(common[a:z], kind="stable")[: joined[i]]
            salt = _vec.mix(np.array([(int(lv[i]) << 32) | 0xFFFFFFFF], dtype=np.uint64))
            out.append((_vec.mix(second[a:z][order] ^ salt), np.full(len(order), i), below, np.full(len(order), lv[i])))
    sig = np.concatenate([x for x, *_ in out])
    whose = np.concatenate([x for _, x, *_ in out]).astype(np.int32)
    low = np.concatenate([np.full(len(x), f, dtype=np.uint32) for x, _, f, _ in out])
    return sig, whose, low, np.concatenate([x for *_, x in out])


def _emit(n, bands, hot_levels, routes, families):
    """Sketches as one row for each part: its documents, and parallel arrays of sketch and document."""

    def run(it):
        hot = hot_levels.value
        members, family = families.value
        begin, number = routes
        parts, many = int(number.sum()), bands.k + bands.shared(number)
        held, total, docs = [], 0, 0

        def flush():
            table = np.concatenate([d for d, *_ in held])
            shift = np.cumsum([0] + [len(d) for d, *_ in held[:-1]], dtype=np.int32)
            value = np.concatenate([v for _, v, _, _ in held])
            who = np.concatenate([w + x for (_, _, w, _), x in zip(held, shift)])
            part = np.concatenate([p for *_, p in held])
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                mine = order[cuts[p] : cuts[p + 1]]
                w = who[mine]
                used = np.zeros(len(table), dtype=bool)
                used[w] = True
                place = np.cumsum(used) - 1
                rows.append((p, table[used].tobytes(), value[mine].tobytes(), place[w].astype(np.uint16).tobytes()))
            for i in range(0, len(rows), 16):
                some = list(zip(*rows[i : i + 16]))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), *(pa.array(x, pa.binary()) for x in some[1:])], ["part", "docs", "sketches", "places"])

        for ids, texts in _batches(it):
            ids, sets = _non_empty(ids, _gram_sets(texts, n))
            if not sets:
                continue
            flat, size = _join_sets(sets)
            table = np.zeros(len(ids), dtype=_DOC)
            table["id"], table["h"], table["n"] = ids, _set_hashes(flat, size)[0], np.minimum(size, (1 << 31) - 1)
            if len(members):
                place = np.minimum(np.searchsorted(members, ids), len(members) - 1)
                table["f"] = np.where(members[place] == ids, family[place], 0)
            sig, who, low, level = _signatures(flat, size, bands, hot, many)
            part = (begin[level] + (sig % np.maximum(number[level], 1).astype(np.uint64)).astype(np.int64)).astype(np.int32)
            sig = ((sig >> _U(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | low
            if held and (docs + len(ids) > 65_000 or total + len(sig) > 1_500_000):
                yield from flush()
                held, total, docs = [], 0, 0
            for a in range(0, len(ids), 65_000):  # a place has 16 bits
                z = min(len(ids), a + 65_000)
                mine = (who >= a) & (who < z) if z - a < len(ids) else slice(None)
                if held and docs + z - a > 65_000:
                    yield from flush()
                    held, total, docs = [], 0, 0
                held.append((table[a:z], sig[mine], who[mine] - np.int32(a), part[mine]))
                total += len(held[-1][1])
                docs += z - a
        if held:
            yield from flush()
        del held
        _vec.trim()

    return run


def _pairs_of_runs(docs, sketches: list, bands: Bands):
    """Pairs of different sets that share sketches, each set under its smallest document, and how many they share.

    `sketches` holds the arrays of sketches and documents, and is emptied, so that they don't outlive their use.
    """
    value, who = sketches.pop()
    slices = len(value) // SLICE + 1
    kept: list[tuple] = []
    for turn in range(slices):
        mine = slice(None) if slices == 1 else np.flatnonzero((value >> np.uint32(1)) % np.uint32(slices) == turn)
        v = value[mine].astype(np.uint64)
        key = ((v >> _U(1)) << _U(33)) | ((v & _U(1)) << _U(32)) | who[mine].astype(np.uint64)
        key.sort()
        same = (key[1:] >> _U(33)) == (key[:-1] >> _U(33))
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        key = key[shared]
        sig, w = (key >> _U(33)).astype(np.uint32), (key & _U(0xFFFFFFFF)).astype(np.int64)
        bit = ((key >> _U(32)) & _U(1)).astype(bool)
        h = docs["h"][w]
        order = np.lexsort((docs["id"][w], h, sig))
        sig, h, w, bit = sig[order], h[order], w[order].astype(np.int32), bit[order]
        first = np.ones(len(sig), dtype=bool)
        first[1:] = (sig[1:] != sig[:-1]) | (h[1:] != h[:-1])
        sig, w, bit = sig[first], w[first], bit[first]
        f = docs["f"][w]
        if f.any():  # members of a family side by side
            order = np.lexsort((docs["h"][w], f, sig))
            sig, w, bit = sig[order], w[order], bit[order]
        more = np.zeros(len(sig), dtype=bool)
        more[1:] = sig[1:] == sig[:-1]
        more[:-1] |= more[1:].copy()
        kept.append((sig[more], w[more], bit[more]))
    sig, who, low = (np.concatenate(x) for x in zip(*kept))
    del kept, value, key, v, mine, w, h, bit, order, first, more, shared, same, f
    # the last place of each one's family in its run, after which its partners begin
    f = docs["f"][who]
    starts = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (f[1:] != f[:-1]) | (f[1:] == 0), [True])))
    own_last = np.repeat(starts[1:] - 1, np.diff(starts)).astype(np.int32)
    inside = np.diff(starts)
    inside = inside * (inside - 1) // 2
    del f, starts
    cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
    length = np.diff(cut)
    at = cut[:-1][length > 1]
    length = length[length > 1]
    if not len(at):
        return
    # pairs are counted in as many passes as memory asks for, by the end that is first in every run: of the smaller family, then set hash
    passes = int(((length * (length - 1) // 2).sum() - inside.sum()) // PAIRS) + 1
    blocks = np.append(np.flatnonzero(np.diff(np.cumsum(length) // BLOCK, prepend=-1)), len(length))
    for turn in range(passes):
        keys = []
        for first, last in zip(blocks[:-1].tolist(), blocks[1:].tolist()):
            run, many = at[first:last], length[first:last]
            where = (np.repeat(run - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))).astype(np.int32)
            end = np.repeat(run + many, many).astype(np.int32)
            if passes > 1:
                own = who[where] % passes == turn
                where, end = where[own], end[own]
            after = own_last[where]
            there = after + 1 < end
            where, after, end = where[there], after[there], end[there]
            partners = (end - after - 1).astype(np.int64)
            # all partners of some members at once: steps through a run would be as many as its members, in every pass
            cuts = np.append(np.flatnonzero(np.diff(np.cumsum(partners) // BLOCK, prepend=-1)), len(partners)).tolist()
            for i, j in zip(cuts[:-1], cuts[1:]):
                many = partners[i:j]
                x = np.repeat(where[i:j], many)
                y = np.repeat(after[i:j] + 1 - (np.cumsum(many) - many), many) + np.arange(len(x))
                ok = ~(low[x] & low[y])
                a, b = who[x[ok]], who[y[ok]]
                ok = bands.similar_sizes(docs["n"][a].astype(np.int64), docs["n"][b].astype(np.int64))
                a, b = a[ok].astype(np.int64), b[ok].astype(np.int64)
                keys.append((np.minimum(a, b) << 32) | np.maximum(a, b))
        if not keys:
            continue
        both, number = np.unique(np.concatenate(keys), return_counts=True)
        yield both >> 32, both & 0xFFFFFFFF, number.astype(np.int32)


def _candidates(bands, parts):
    """Pairs of a part, with how many sketches they share beyond what may stay there, and how many of those all parts must have."""

    def run(it):
        most, need = (x.astype(np.int32) for x in bands.asked(parts))
        by_part: dict[int, list] = {}
        for batch in it:
            for p, d, s, w in zip(*(c.to_pylist() for c in batch.columns)):
                by_part.setdefault(p, []).append((np.frombuffer(d, _DOC), np.frombuffer(s, np.uint32), np.frombuffer(w, np.uint16)))
        while by_part:
            blobs = by_part.popitem()[1]
            shift = np.concatenate(([0], np.cumsum([len(d) for d, _, _ in blobs])[:-1]))
            docs = np.concatenate([d for d, _, _ in blobs])
            n = sum(len(s) for _, s, _ in blobs)
            sketches, at = [(np.empty(n, np.uint32), np.empty(n, np.int32))], 0
            for i in range(len(blobs)):  # each is let go as soon as it is copied
                _, s, w = blobs[i]
                blobs[i] = None
                sketches[0][0][at : at + len(s)] = s
                sketches[0][1][at : at + len(s)] = w
                sketches[0][1][at : at + len(s)] += np.int32(shift[i])
                at += len(s)
            del blobs, s, w
            for a, b, number in _pairs_of_runs(docs, sketches, bands):
                for i in range(0, len(a), 1 << 17):
                    x, y = docs[a[i : i + (1 << 17)]], docs[b[i : i + (1 << 17)]]
                    level = bands.of(np.minimum(x["n"], y["n"]).astype(np.int64))
                    left = number[i : i + (1 << 17)] - most[level]
                    ok = (x["id"] != y["id"]) & (left > 0)
                    p, q = np.minimum(x["id"], y["id"])[ok], np.maximum(x["id"], y["id"])[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(left[ok]), pa.array(need[level][ok])], ["a", "b", "number", "need"])
        _vec.trim()

    return run


def _gram_rows(n, wanted):
    """Grams of the documents that are in a candidate pair."""

    def run(it):
        ids = wanted.value if wanted is not None else None
        for batch in it:
            got = tuple(_rows(batch))
            if not got:
                continue
            some = np.array(got[0], dtype=np.int64)
            if ids is not None:
                place = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
                hit = np.flatnonzero(ids[place] == some)
            else:
                hit = np.arange(len(some))
            texts = [got[1][i] for i in hit]
            for a, b in _vec.slices(_lengths(texts), CHARS):
                which, sets = _non_empty(some[hit[a:b]], _gram_sets(texts[a:b], n))
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "payload"])

    return run


def _whole_cells(it):
    """Batches of a partition that is sorted by cell, some whole cells at a time."""
    held, size = [], 0
    for batch in it:
        cell = np.array(batch.column(0))
        while len(cell) and size > CELLS:
            same = cell == held[-1].column(0)[-1].as_py()
            n = len(cell) if same.all() else int(np.argmin(same))
            if n:
                held.append(batch.slice(0, n))
            batch, cell = batch.slice(n), cell[n:]
            if len(cell):
                yield held
                held, size = [], 0
                break
        if len(cell):
            # memory is that of the rows left, not of the batch that they are a view of
            size += batch.nbytes
            held.append(batch)
    if held:
        yield held


def _read(batches):
    """Ids and payloads of the documents of some cells, and pairs as their numbers.

    A document of two cells comes twice and is kept once. Of an id with several texts, each text counts.
    """
    payloads: dict[int, dict[bytes, int]] = {}
    ids, rows, left, right = [], [], [], []
    for batch in batches:
        _, a, b, data = (c for c in batch.columns)
        is_pair = np.array(data.is_null())
        pa_, pb_ = np.array(a)[is_pair], np.array(b.fill_null(0))[is_pair]
        left.append(pa_)
        right.append(pb_)
        for key, d in zip(np.array(a)[~is_pair].tolist(), data.filter(pa.array(~is_pair)).to_pylist()):
            own = payloads.setdefault(key, {})
            if d not in own:
                own[d] = len(rows)
                ids.append(key)
                rows.append(d)
    none = np.zeros(0, dtype=np.int64)
    if not rows:
        return none, [], none.reshape(-1, 2)
    x = np.stack([np.concatenate(left), np.concatenate(right)], 1)
    first = {k: next(iter(v.values())) for k, v in payloads.items()}
    pairs = np.array([[first[p], first[q]] for p, q in x.tolist()], dtype=np.int64).reshape(-1, 2)
    several = {k: list(v.values()) for k, v in payloads.items() if len(v) > 1}
    if several:
        more = [[i, j] for p, q in x.tolist() if p in several or q in several for i in several.get(p, [first[p]]) for j in several.get(q, [first[q]])]
        pairs = np.unique(np.concatenate([pairs, np.array(more, dtype=np.int64).reshape(-1, 2)]), axis=0)
    return np.array(ids, dtype=np.int64), rows, pairs


def _near_sketches(bands):
    """Pairs whose sketches differ in no more bits than their sets may differ in grams."""

    def each(batches):
        ids, payload, x = _read(batches)
        if not len(x):
            return
        size = np.array([int.from_bytes(v[:8], "little") for v in payload], dtype=np.int64)
        rows = [np.frombuffer(v, np.uint64, offset=8) for v in payload]
        length = np.array([len(r) for r in rows])
        least = np.minimum(length[x[:, 0]], length[x[:, 1]])
        t = bands.t
        most = (size[x].sum(axis=1) * (t.denominator - t.numerator)) // (t.denominator + t.numerator)
        ok = bands.similar_sizes(size[x[:, 0]], size[x[:, 1]])
        for words in np.unique(least).tolist():
            mine = np.flatnonzero((least == words) & ok)
            for s in range(0, len(mine), max(1, (1 << 21) // words)):
                at = mine[s : s + max(1, (1 << 21) // words)]
                used, back = np.unique(x[at], return_inverse=True)
                table = np.stack([np.bitwise_xor.reduce(_fold(rows[i], words), axis=0) for i in used])
                back = back.reshape(-1, 2)
                apart = np.bitwise_count(table[back[:, 0]] ^ table[back[:, 1]]).sum(axis=1, dtype=np.int64)
                ok[at] = apart <= most[at]
        for s in range(0, int(ok.sum()), 1 << 17):
            at = np.flatnonzero(ok)[s : s + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[at, 0]]), pa.array(ids[x[at, 1]])], ["a", "b"])

    def run(it):
        for batches in _whole_cells(it):
            yield from each(batches)
        _vec.trim()

    return run


def _fold(row, words):
    """A sketch of more bits as rows of `words` 64-bit words, the XOR of which is the sketch of fewer bits."""
    return row.reshape(-1, words)


def _verify(bands):
    """Exact overlap of the pairs of a cell, whose documents' grams are in the same partition."""

    def each(batches):
        ids, payload, x = _read(batches)
        if not len(x):
            return
        sets = [np.frombuffer(v, np.uint64) for v in payload]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(int(local.max()) + 1, dtype=bool)
        x = x[np.argsort(x[:, 0], kind="stable")]
        inter = np.zeros(len(x), dtype=np.int64)
        cut = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0], [True])))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            i = x[a, 0]
            mine = local[starts[i] : starts[i + 1]]
            mark[mine] = True
            for s in range(a, z, 512):
                others = x[s : min(z, s + 512), 1]
                n = size[others]
                at = np.concatenate(([0], np.cumsum(n)[:-1]))
                flat = local[np.repeat(starts[others] - at, n) + np.arange(int(n.sum()))]
                inter[s : s + len(others)] = np.add.reduceat(mark[flat].astype(np.int64), at)
            mark[mine] = False
        na, nb = size[x[:, 0]], size[x[:, 1]]
        ok = bands.enough(inter, na, nb)
        p, q = ids[x[ok, 0]], ids[x[ok, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(inter[ok] / (na + nb - inter)[ok])], ["a", "b", "jaccard"])

    def run(it):
        for batches in _whole_cells(it):
            yield from each(batches)
        _vec.trim()

    return run


def _little_endian(column):
    """A long as eight bytes, the lowest first."""
    return F.expr(f"unhex(concat_ws('', transform(sequence(7, 0, -1), i -> substr(lpad(hex({column}), 16, '0'), 2 * i + 1, 2))))")


def _small(df):
    """`df`, to be broadcast if its rows, which are a few numbers each, are counted and not many."""
    return F.broadcast(df) if df.count() <= FILTER_MAX // 4 else df


def _cells(scratch, pairs):
    """Pairs by cell, and the documents of each cell.

    A cell holds pairs whose ends have the same two labels. A document's label is its smallest neighbour or
    itself, so that near cliques fall in one cell; labels of many documents are cut in chunks.
    """
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("id", "o")
    label = ends.groupBy("id").agg(F.min("o").alias("o")).select("id", F.least("o", "id").alias("label"))
    share = label.groupBy("label").agg(F.ceil(F.count("*") / 1024).alias("chunks"))
    label = scratch.keep(label.join(share, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), "chunks")).alias("label")))
    label = _small(label)
    left, right = (label.select(F.col("id").alias(i), F.col("label").alias(x)) for i, x in (("a", "la"), ("b", "lb")))
    placed = pairs.join(left, "a").join(right, "b").select(F.xxhash64(F.least("la", "lb"), F.greatest("la", "lb")).alias("cell"), "a", "b")
    placed = scratch.keep(placed)
    return placed, scratch.keep(placed.select("cell", F.col("a").alias("id")).union(placed.select("cell", "b")).distinct())


def _in_cells(placed, members, payloads, parts):
    """Each cell's pairs, and the payloads of its documents, in one partition."""
    rows = payloads.join(_small(members), "id").select("cell", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "payload")
    return rows.union(placed.select("cell", "a", "b", F.lit(None).cast("binary").alias("payload"))).repartition(parts, "cell").sortWithinPartitions("cell")


def _alike(it):
    """Documents and the first of those that share a key with them, where their sketches are alike."""
    for batch in it:
        d, n, a, leader, m, b = (c.to_pylist() for c in batch.columns)
        keep = []
        for i in range(len(d)):
            x, y = np.frombuffer(a[i], np.uint64), np.frombuffer(b[i], np.uint64)
            words = min(len(x), len(y))
            apart = int(np.bitwise_count(np.bitwise_xor.reduce(_fold(x, words), axis=0) ^ np.bitwise_xor.reduce(_fold(y, words), axis=0)).sum())
            if apart <= ALIKE * 32 * words * -np.expm1(-(n[i] + m[i]) / (32 * words)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (d, leader)], ["l", "r"])


def _families(scratch, described, copies, bands):
    """`(id, f, chunk, chunks, weight)` of the members of large families, each a set under its smallest id; None without any.

    Ids with several sets are in none, and where members are too many to broadcast, nor are those of the smaller families.
    """
    spark = scratch.spark
    known = copies.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "node", "size")
    nodes = described.join(_small(known), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").where("node is null or node = doc_id")
    nodes = nodes.select("doc_id", "h1", "h2", "n", "sketch", "keys", F.coalesce("size", F.lit(1).cast("long")).alias("weight"))
    # sets of similar sizes are on the same level or on the next
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(float(1 / bands.t)))).cast("int")
    keyed = nodes.select("doc_id", "n", "sketch", level.alias("level"), F.posexplode("keys").alias("at", "key")).select("doc_id", "n", "sketch", "at", "key", F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"))
    heavy = scratch.keep(keyed.groupBy("at", "key", "level").agg(F.count("*").alias("c"), F.min("doc_id").alias("leader")).where(F.col("c") >= FAMILY))
    many = heavy.count()
    if not many:
        return None
    few = F.broadcast if many <= 50_000 else lambda df: df
    first = nodes.join(few(heavy.select(F.col("leader").alias("doc_id")).distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("n", "sketch")).alias("s"))
    leaders = scratch.keep(heavy.join(first, heavy["leader"] == first["doc_id"]).select("at", "key", "level", "leader", F.col("s.n").alias("m"), F.col("s.sketch").alias("b")))
    found = keyed.join(few(leaders), ["at", "key", "level"]).where("doc_id <> leader").select("doc_id", "n", "sketch", "leader", "m", "b").mapInArrow(_alike, "l long, r long")
    # an id with several sets would stand for all of them
    root = scratch.keep(connected_components(scratch.keep(found.distinct())).toDF("doc_id", "root"))
    sets = nodes.join(_small(root), "doc_id").groupBy("doc_id", "root").agg(F.min("n").alias("n"), F.max("weight").alias("weight"))
    several = described.join(_small(root), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("h1").alias("p"), F.max("h1").alias("q"), F.min("h2").alias("r"), F.max("h2").alias("s")).where("p <> q or r <> s")
    sets = scratch.keep(sets.join(several, "doc_id", "left_anti"))
    sizes = sets.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where(F.col("m") >= FAMILY).orderBy(F.desc("m"), "root").limit(max(1, FILTER_MAX // FAMILY)).toPandas()
    sizes = sizes[sizes["m"].cumsum() <= FILTER_MAX]
    if not len(sizes):
        return None
    rows = [(int(r), i + 1, int(max(-(-m // CHUNK_DOCS), -(-g // CHUNK_GRAMS)))) for i, (r, m, g) in enumerate(sizes.itertuples(index=False))]
    numbered = spark.createDataFrame(rows, "root long, f long, chunks long")
    return scratch.keep(sets.join(F.broadcast(numbered), "root").select(F.col("doc_id").alias("id"), "f", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), "chunks", "weight"))


def _overlaps(sets, left, right):
    """Grams in common of each set of `left` with each of `right`, both ascending numbers of sets, which are the same or apart."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    whose = np.repeat(np.arange(m), size)
    _, gram, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.full(m, -1, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    # grams of many sets by a product of matrices, those of few pair by pair
    dense = df >= max(8, m // 16)
    place = np.cumsum(dense) - 1
    at = np.flatnonzero(dense[gram])
    at = at[np.argsort(place[gram[at]], kind="stable")]
    slot, owner = place[gram[at]], whose[at]
    for s in range(0, int(dense.sum()), 512):
        a, z = np.searchsorted(slot, (s, s + 512))
        has = np.zeros((m, 512), dtype=np.float32)
        has[owner[a:z], slot[a:z] - s] = 1
        out += has[left] @ has[right].T
    at = np.flatnonzero((df > 1)[gram] & ~dense[gram])
    at = at[np.argsort(gram[at], kind="stable")]
    g, owner = gram[at], whose[at]
    cells = out.reshape(-1)
    where, step = np.arange(len(g)), 1
    while len(where):
        where = where[where + step < len(g)]
        where = where[g[where] == g[where + step]]
        for a, b in ((owner[where], owner[where + step]), (owner[where + step], owner[where])):
            ok = (row[a] >= 0) & (column[b] >= 0)
            np.add.at(cells, row[a[ok]] * len(right) + column[b[ok]], np.float32(1))
        step += 1
    return out, size


def _inside(bands, as_pairs):
    """Of each cell of a family: the links of its documents and a forest of them, or the pairs themselves."""

    def each(ids, side, weight, sets):
        ids, first = np.unique(ids, return_index=True)
        side, weight, sets = side[first], weight[first], [np.frombuffer(sets[i], np.uint64) for i in first]
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        if not len(left) or not len(right):
            return
        inter, size = _overlaps(sets, left, right)
        near = np.zeros(inter.shape, dtype=bool)
        for s in range(0, len(left), 256):
            mine = left[s : s + 256]
            near[s : s + 256] = bands.enough(inter[s : s + 256].astype(np.int64), size[mine][:, None], size[right][None, :]) & (mine[:, None] != right[None, :])
        same = bool((side == 0).all())
        if as_pairs:
            i, j = np.nonzero(near)
            both = inter[i, j].astype(np.int64)
            i, j = left[i], right[j]
            jaccard = both / (size[i] + size[j] - both)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            ok = (ids[i] < ids[j]) | (not same)
            for s in range(0, int(ok.sum()), 1 << 17):
                some = np.flatnonzero(ok)[s : s + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some]), pa.array(jaccard[some])], ["a", "b", "jaccard"])
            return
        links = np.zeros(len(ids), dtype=np.int64)
        for s in range(0, len(left), 256):
            links[left[s : s + 256]] += near[s : s + 256] @ weight[right]
            if not same:
                links[right] += weight[left[s : s + 256]] @ near[s : s + 256]
        root = np.arange(len(ids))
        while True:
            then = root.copy()
            least = np.full(len(right), len(ids))
            for s in range(0, len(left), 256):
                mine, some = left[s : s + 256], near[s : s + 256]
                then[mine] = np.minimum(then[mine], np.where(some, root[right][None, :], len(ids)).min(axis=1))
                least = np.minimum(least, np.where(some, root[mine][:, None], len(ids)).min(axis=0))
            then[right] = np.minimum(then[right], least)
            then = then[then]
            if (then == root).all():
                break
            root = then
        i, j = np.flatnonzero(links), np.flatnonzero(root < np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[i], ids[root[j]]])), pa.array([None] * len(i) + ids[j].tolist(), pa.int64()), pa.array(np.concatenate([links[i], np.zeros_like(j)]), pa.int64())], ["a", "b", "links"])

    def run(it):
        for batches in _whole_cells(it):
            cell, ids, side, weight = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(4))
            payload = [x for b in batches for x in b.column(4).to_pylist()]
            cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield from each(ids[a:z], side[a:z], weight[a:z], payload[a:z])
        _vec.trim()

    return run


def _within(scratch, texts, members, n, bands, wanted, parts, as_pairs):
    """All links inside families, as `_inside` gives them."""
    grams = texts.mapInArrow(_gram_rows(n, wanted), "id long, payload binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    rows = grams.join(_small(members), "id").select("id", "payload", "f", "chunk", "weight", other.alias("o"))
    cell = F.shiftleft("f", 40) + F.shiftleft(F.least("chunk", "o"), 20) + F.greatest("chunk", "o")
    rows = rows.select(cell.alias("cell"), "id", F.signum(F.col("chunk") - F.col("o")).cast("int").alias("side"), "weight", "payload")
    cells = rows.repartition(parts, "cell").sortWithinPartitions("cell")
    return scratch.keep(cells.mapInArrow(_inside(bands, as_pairs), "a long, b long, jaccard double" if as_pairs else "a long, b long, links long"))


class Links(NamedTuple):
    """What the join knows, as tables in the shared folder."""

    #: `(doc_id, n)`: every document and the size of its set; sets are told apart by `h1, h2`.
    documents: DataFrame
    #: `(h1, h2, node, size)`: sets that several documents have, the smallest id of them and their number.
    copies: DataFrame
    #: `(a, b, jaccard)`, a < b: different sets, each under its smallest id; without `inner`, all of them.
    near: DataFrame
    #: `(a, b, links)` of links inside families: documents linked to `a`, where `b` is null, else edges of a forest. None: no families, or in `near`.
    inner: DataFrame | None

    def edges(self) -> DataFrame:
        """`(a, b)` that connect the same documents as all links."""
        edges = self.near.select("a", "b")
        return edges if self.inner is None else edges.union(self.inner.where("b is not null").select("a", "b"))


def links(docs: DataFrame, n: int | None, threshold: float, id_col: str, text_col: str, scratch: Scratch, as_pairs: bool = False) -> Links:
    """The join of texts' `n`-grams; with None for `n`, `text_col` is an array of longs, the hashes of a set that was made elsewhere."""
    with arrow_rows(docs.sparkSession, 1000), no_old_shuffles(docs.sparkSession):
        spark = docs.sparkSession
        bands = Bands(threshold)
        texts = docs.select(_columns.named(id_col).cast("long").alias("doc_id"), _columns.named(text_col).alias("text"))
        total = max(1, docs.count())
        hot_df = max(32, isqrt(total) // 8)
        summary = scratch.keep(texts.mapInArrow(_summarise(n, hot_df / total), "doc_id long, h1 long, h2 long, n long, sketch binary, keys array<long>"))
        documents = summary.where("doc_id is not null")
        described = documents.where("n > 0")
        sets = described.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("size"))
        copies = scratch.keep(sets.where("size > 1"))
        if bands.t == 1:
            near, inner = spark.createDataFrame([], "a long, b long, jaccard double"), None
        else:
            parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
            members = _families(scratch, described, copies, bands)
            family, inner = (np.zeros(0, np.int64), np.zeros(0, np.uint32)), None
            if members is not None:
                at = members.select("id", "f").toPandas().sort_values("id")
                family = (at["id"].to_numpy(np.int64), at["f"].to_numpy(np.uint32))
                inner = _within(scratch, texts, members, n, bands, spark.sparkContext.broadcast(family[0]), parts, as_pairs)
            near = _near(spark, scratch, texts, summary, described, bands, n, hot_df, family)
            if as_pairs and inner is not None:
                near, inner = near.union(inner), None
        return Links(documents.select("doc_id", "h1", "h2", "n"), copies, near, inner)


def _near(spark, scratch, texts, summary, described, bands, n, hot_df, family) -> DataFrame:
    counts = summary.where("doc_id is null").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_df)
    # how common a gram is, in steps of a factor of 1.41; those of large families come before those of all texts
    hot = np.zeros(1 << 24, dtype=np.uint8)
    known = counts.orderBy(F.desc("n"), "h1").limit(HOT_MAX).toPandas()
    np.maximum.at(hot, (known["h1"].to_numpy(np.int64) >> 40) & 0xFFFFFF, (1 + 2 * np.log2(np.maximum(1, known["n"].to_numpy(np.float64) / hot_df))).astype(np.uint8))
    hot_levels = spark.sparkContext.broadcast(hot)
    families = spark.sparkContext.broadcast(family)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near_size = F.round(F.pow(F.lit(1.02), F.round(F.log(F.col("n")) / F.log(F.lit(1.02))))).cast("long")
    sizes = dict(tuple(r) for r in described.groupBy(near_size.alias("n")).count().collect())
    routes = bands.routes(sizes)
    emitted = texts.mapInArrow(_emit(n, bands, hot_levels, routes, families), "part int, docs binary, sketches binary, places binary")
    found = emitted.repartitionById(max(1, int(routes[1].sum())), F.col("part")).mapInArrow(_candidates(bands, routes[1]), "a long, b long, number int, need int")
    placed, members = _cells(scratch, scratch.keep(found.groupBy("a", "b").agg(F.sum("number").alias("number"), F.min("need").alias("need")).where("number >= need").select("a", "b")))
    sketches = described.select(F.col("doc_id").alias("id"), F.concat(_little_endian("n"), "sketch").alias("payload"))
    sketches = sketches.join(_small(scratch.keep(members.select("id").distinct())), "id", "left_semi")
    near = _in_cells(placed, members, sketches, parts).mapInArrow(_near_sketches(bands), "a long, b long")
    return _checked(scratch, texts, near.distinct(), n, bands)


def _checked(scratch, texts, pairs, n, bands) -> DataFrame:
    """`(a, b, jaccard)` of the pairs `(a, b)` that have the threshold, exactly; the sets of their ends are brought together in cells."""
    spark = scratch.spark
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed, members = _cells(scratch, scratch.keep(pairs))
    few = scratch.keep(members.select("id").distinct())
    wanted = None
    if few.count() <= FILTER_MAX:
        wanted = spark.sparkContext.broadcast(np.sort(few.toPandas()["id"].to_numpy(dtype=np.int64)))
        some = texts if len(wanted.value) else texts.limit(0)
    else:
        some = texts.join(few, texts["doc_id"] == few["id"], "left_semi")
    grams = some.mapInArrow(_gram_rows(n, wanted), "id long, payload binary")
    near = _in_cells(placed, members, grams, parts).mapInArrow(_verify(bands), "a long, b long, jaccard double").where("a <> b")
    return scratch.keep(near.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")))


class Least(NamedTuple):
    """A threshold of any size, for pairs that are known."""

    t: Fraction

    enough = Bands.enough


def checked(rows: DataFrame, pairs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """`(a, b, jaccard)` of those of `pairs(a, b)` that have the threshold, over `rows(id, grams)`."""
    with arrow_rows(rows.sparkSession, 1000), no_old_shuffles(rows.sparkSession):
        return _checked(scratch, rows.select(F.col("id").alias("doc_id"), F.col("grams").alias("text")), pairs, None, Least(Fraction(str(threshold))))


def nodes(found: Links) -> DataFrame:
    """`(doc_id, node, size)` of every document; one whose set nobody shares is its own node."""
    copies = found.copies.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2")
    same = (F.col("n") > 0) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return found.documents.distinct().join(_small(copies), same, "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id_a, doc_id_b, jaccard)`, `doc_id_a < doc_id_b`: the join's pairs themselves.

    Documents with equal sets are one node, the smallest id of them; each other one of them has one row, with
    that node and 1.0. Rows between nodes are complete, so their number grows with the square of a family
    of different texts. Inputs are read as `ngram_jaccard_join` reads them.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = links(docs, n, threshold, id_col, text_col, scratch, as_pairs=True)
    equal = nodes(found).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    every = found.near.union(equal).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    return scratch.finish(every.toDF("doc_id_a", "doc_id_b", "jaccard"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, class_id, n_links)`: one row for each document, of links with Jaccard >= `threshold`.

    Two documents are linked if their sets of distinct word `n`-grams have that Jaccard. `n_links` counts the
    documents that a document is linked to, copies among them; `class_id` is the smallest id that it is connected
    to through links, its own if it has none. A text of under `n` words has one gram, its whole word list.
    Null, empty and word-less texts are linked to nothing and have their row; rows with a null id have none. Rows that
    repeat id and text are one; an id whose texts differ has a row for each different set. Ids are whole
    numbers. Other columns, of whatever name, are not read. Empty input gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = links(docs, n, threshold, id_col, text_col, scratch)
    weight = found.copies.groupBy("node").agg(F.sum("size").alias("weight"))
    near = found.near.select("a", "b").union(found.near.select("b", "a")).toDF("node", "o")
    weighed = near.join(_small(weight).withColumnRenamed("node", "o"), "o", "left").groupBy("node").agg(F.sum(F.coalesce("weight", F.lit(1).cast("long"))).alias("links"))
    if found.inner is not None:
        weighed = weighed.union(found.inner.where("b is null").select("a", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    root = connected_components(found.edges(), "a", "b")
    known = scratch.keep(weighed.join(root, "node"))
    out = nodes(found).join(_small(known), "node", "left")
    return scratch.finish(out.select("doc_id", F.coalesce("root", "node").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest id.

    Classes are those of `ngram_jaccard_join`. Documents without a link stay, also those with a null id or text.
    All columns are kept as they are, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "duplicates")
    found = links(docs, n, threshold, "doc_id", "text", scratch)
    root = connected_components(found.edges(), "a", "b")
    gone = nodes(found).join(_small(scratch.keep(root)), "node", "left").where("doc_id <> coalesce(root, node)")
    key = _columns.fresh(docs, "gone")
    drop = scratch.finish(gone.select(F.col("doc_id").alias(key)).distinct())
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(key), "left_anti").select(*_columns.every(docs))
