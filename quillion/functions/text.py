"""Text functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"\p{IsAlphabetic}\p{N}"
MIN_LINES, MIN_WORDS = 2, 8
SHINGLE = 3
#: What a text or line must have for the comparison form to differ from the counting form.
_SIGNS = "[<>=]|-[0-9]"
_MINUS, _BANG = "\ue000", "\ue001"


def _lower(c: Column) -> Column:
    """Lower case by single characters: no rule for a sigma at a word's end."""
    return F.lower(F.translate(c, "Σ", "σ"))


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def normalize(c: Column) -> Column:
    """The counting form: letters and numbers in lower case, one space between words."""
    return F.trim(_lower(F.regexp_replace(c, f"[^{ALNUM}]+", " ")))


def _comparable_line(line: Column) -> Column:
    line = F.translate(line, _MINUS + _BANG, "")
    line = F.regexp_replace(line, f"(?<![{ALNUM}])-(?=[0-9])", _MINUS)
    line = F.regexp_replace(line, "!(?==)", _BANG)
    head = F.regexp_extract(line, f"^[^{ALNUM}]*", 0)
    line = F.concat(F.translate(head, ">", " "), F.substring(line, F.length(head) + 1, F.lit(2147483647)))
    line = F.regexp_replace(line, f"[^{ALNUM}<>={_MINUS}{_BANG}]", " ")
    return F.regexp_replace(F.translate(line, _MINUS + _BANG, "-!"), "([<>=!-])", " $1 ")


def normalize_comparable(c: Column) -> Column:
    """The comparison form: as `normalize`, with comparison operators and signs kept as words of their own.

    Only in lines that have a letter or number; `>` only behind one, `!` only before `=`, `-` only before a
    digit and not behind a letter or number.
    """

    def form(x: Column) -> Column:
        lines = F.transform(F.split(x, "\r?\n"), lambda y: F.when(y.rlike(f"[{ALNUM}]"), F.when(y.rlike(_SIGNS), _comparable_line(y)).otherwise(F.regexp_replace(y, f"[^{ALNUM}]+", " "))).otherwise(F.lit("")))
        return F.when(x.rlike(_SIGNS), _collapse(_lower(F.array_join(lines, " ")))).otherwise(normalize(x))

    return _bound(c, form)


def words(c: Column) -> Column:
    """Words of a normalised text; none of an empty one."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def size_words(normalized: Column) -> Column:
    return F.size(words(normalized))


def size_lines(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def large_enough(lines: Column, n_words: Column) -> Column:
    return (lines >= MIN_LINES) & (n_words >= MIN_WORDS)


def _bound(c: Column, f) -> Column:
    """`f` of `c`, with `c` evaluated once however often `f` uses it."""
    return F.transform(F.array(c), f)[0]


def _runs(w: Column, k: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of `k` words, joined by a space; none if there are fewer words."""
    return _bound(w, lambda x: _runs(x, k))


def shingle_hashes(w: Column, k: int = SHINGLE, short: bool = False) -> Column:
    """Distinct 64-bit hashes of the runs of `k` words; with `short`, a shorter text that has words is one run.

    Words are hashed once, and runs from the hashes of their words, so no run is built as a string.
    """
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    none = F.array().cast("array<bigint>")
    few = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none) if short else none
    return _bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= k, F.array_distinct(runs(h))).otherwise(few(h)))


def corpus_shingles(w: Column, k: int = SHINGLE) -> Column:
    """As `shingles`, but a shorter text is one short gram."""
    return _bound(w, lambda x: F.when((F.size(x) < k) & (F.size(x) > 0), F.array(F.array_join(x, " "))).otherwise(_runs(x, k)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two duplicate-free arrays over their union; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def address(path: Column, start: Column, end: Column) -> Column:
    """`path:line`, or `path:line-end` if it ends on a later line."""
    return F.concat(path, F.lit(":"), start.cast("string"), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit("")))


def volume_message(at: Column, code: Column, kind: Column, n: Column, most: Column) -> Column:
    return F.concat(at, F.lit(": "), code, F.lit(" "), kind, F.lit(" is "), n.cast("string"), F.lit(" words long, over the "), most.cast("string"), F.lit("-word limit — shorten it, or mark it with `# !"), code, F.lit("` on the line above it"))


def half_even(score: Column, digits: int = 3) -> Column:
    """A similarity with `digits` decimals, by the exact value of the double: only what is a half exactly goes to the even digit."""
    return F.format_number(score, digits)


def folded(others: Column, most: int = 10) -> Column:
    """The first `most` addresses, and how many more there are."""
    rest = F.when(F.size(others) > most, F.concat(F.lit(", … and "), (F.size(others) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(others, 1, most), ", "), rest)


def cluster_message(at: Column, n: Column, others: Column, first: Column, second: Column, score: Column) -> Column:
    return F.concat(at, F.lit(": TPX003 same explanation in "), n.cast("string"), F.lit(" places: "), folded(others), F.lit(" (weakest "), first, F.lit(" ~ "), second, F.lit(", similarity "), half_even(score), F.lit(")"))


def stem(w: Column) -> Column:
    """`w` without the first of five endings that leaves at least three letters."""
    out = w
    for ending in ("s", "es", "ed", "ies", "ing"):
        n = len(ending)
        out = F.when((F.length(w) > n + 2) & w.endswith(ending), F.substring(w, F.lit(1), F.length(w) - n)).otherwise(out)
    return out


def path_key(path: Column) -> Column:
    """Sort key of a path by components: root, `.` in front, `..`, names."""
    rank = lambda c: F.when(c == ".", 2).when(c == "..", 3).otherwise(4)
    split = F.split(path, "/")
    parts = F.filter(split, lambda c, i: (c != "") & ((c != ".") | (i == 0)))
    named = F.transform(parts, lambda c: F.struct(rank(c).alias("rank"), c.alias("name")))
    root = F.array(F.struct(F.lit(1).alias("rank"), F.lit("").alias("name")))
    return F.when(path.startswith("/"), F.concat(root, named)).otherwise(named)


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "docstring", 0).otherwise(1)
