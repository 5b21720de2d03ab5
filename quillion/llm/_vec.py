"""Vectorised word tokens and n-gram hashes over batches of whole texts.

Every operator that walks words uses the same definition, the SQL form of which is
``regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')``: a word is a maximal run of letters,
numbers and marks, lower-cased code point by code point so that offsets in the text stay valid.

Words are never built as Python objects. A batch of texts becomes one array of code points, and the
hash of every word comes from prefix sums of a polynomial modulo 2**64, finished with a mixing step.
Texts are processed whole; long ones are walked in windows that are cut between words.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np

WINDOW = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


class Words(NamedTuple):
    """Words of a batch in text order: mixed hash, text number, offsets inside that text."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it belongs to a word, and its lower-case form."""
    n = 0x110000
    word = np.zeros(n, dtype=bool)
    lower = np.arange(n, dtype=np.uint32)
    for i in range(n):
        if 0xD800 <= i < 0xE000 or 0xF0000 <= i:
            continue
        c = chr(i)
        if unicodedata.category(c)[0] in "LNM":
            word[i] = True
            low = c.lower()
            if low != c and len(low) == 1:
                lower[i] = ord(low)
    return word, lower


@functools.cache
def _lower_map() -> dict[int, int]:
    lower = tables()[1]
    return {int(i): int(lower[i]) for i in np.flatnonzero(lower != np.arange(len(lower)))}


def fold(text: str) -> str:
    """`text` in lower case, code point by code point, as the hashes of words have it."""
    return text.translate(_lower_map())


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        a = np.full(n, _U(b), dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, a line feed between them, and each text's offset."""
    joined = "\n".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cps, starts


def words(texts: list[str]) -> Words:
    """The words of each text. A missing text must be given as an empty one; it has no words."""
    if not any(texts):
        z = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), z, z, z)
    cps, starts = code_points(texts)
    is_word, lower = tables()
    hashes, firsts, lasts = [], [], []
    at, n = 0, len(cps)
    while at < n:
        stop = min(n, at + WINDOW)
        if stop < n:  # cut between words
            while True:
                gaps = np.flatnonzero(~is_word[cps[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    break
                if stop == n:
                    break
                stop = min(n, stop + WINDOW)
        w = cps[at:stop]
        mask = is_word[w]
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        first, last = edge[~mask[edge - 1]], edge[mask[edge - 1]]
        if len(mask) and mask[0]:
            first = np.concatenate(([0], first))
        if len(mask) and mask[-1]:
            last = np.concatenate((last, [len(mask)]))
        size = 1 << max(10, (len(w) - 1).bit_length())
        power, inverse = _powers(size)
        sums = np.zeros(len(w) + 1, dtype=np.uint64)
        np.cumsum((lower[w].astype(np.uint64) + _U(0x51ED27)) * power[: len(w)], out=sums[1:])
        h = (sums[last] - sums[first]) * inverse[first]
        hashes.append(mix(h + (last - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        firsts.append(first + at)
        lasts.append(last + at)
        at = stop
    first, last = np.concatenate(firsts).astype(np.int64), np.concatenate(lasts).astype(np.int64)
    doc = np.searchsorted(starts, first, side="right") - 1
    return Words(np.concatenate(hashes), doc, first - starts[doc], last - starts[doc])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that start at each word; the last n-1 words start none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h = h * _U(0xC2B2AE3D27D4EB4F) + hashes[i : i + m]
    return mix(h)


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; one of under n words has its whole word list as its one gram."""
    w = words(texts)
    bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    every = grams(w.hash, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(grams(w.hash[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def slices(lengths: list[int], limit: int):
    """Ranges of consecutive texts of about `limit` characters together, one text at least."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def trim() -> None:
    """Give freed memory back to the system; a Python worker lives on with what it once took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
