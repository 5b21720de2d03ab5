"""Line-first quality rules (operator 4).

Every line of a text is judged by itself: it must end like a sentence, not look like navigation, hold no
boilerplate, and be neither symbol noise, shouting nor a stutter. Lines that fail go; a document that
loses more than half of its text that way is rejected. Everything is one projection of built-in
expressions over the scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm import _columns

#: A line ends like a sentence, closing quotes and brackets aside.
END = r"[.!?…。！？:;][\"'”’»)\]]*$"
#: Navigation: three or more separators, or a lone menu arrow.
NAVIGATION = r"([|›»•·].*){3}|^(home|menu|next|previous|skip to|back to)\b"
BOILERPLATE = (
    r"licensed under|creative commons|general public license|all rights reserved|copyright (©|\(c\))|terms of (use|service)"
    r"|privacy policy|cookies? (policy|settings)|enable javascript|lorem ipsum|subscribe to|sign (in|up) to|click here"
)
SYMBOL = r"[#$%&*@^~|<>{}=_\\]"
LOUD = r"!!"
#: Of a line's length (words), at most this share may be symbols (must be different words, for long lines).
MAX_SYMBOLS = 0.1
MIN_WORDS_STUTTER = 16
MIN_DISTINCT = 0.25
MAX_LOSS = 0.5


def good_line(line: Column) -> Column:
    """Whether a trimmed, non-blank line passes every rule; cheap rules come first."""
    low = F.lower(line)
    words = F.split(line, " +")
    return (
        line.rlike(END)
        & ~low.rlike(NAVIGATION)
        & ~low.rlike(BOILERPLATE)
        & (F.size(F.split(line, SYMBOL)) - 1 <= F.length(line) * MAX_SYMBOLS)
        & ~((F.size(F.split(line, LOUD)) - 1) * 4 > F.size(words))
        & ~((F.size(words) >= MIN_WORDS_STUTTER) & (F.size(F.array_distinct(words)) < F.size(words) * MIN_DISTINCT))
    )


def _judged(text: Column) -> Column:
    """An array of one struct `(text, n_lines, n_kept, n_chars, n_left)` for a document that passes, else of none.

    Nested lambdas bind each step once, so that neither the lines nor the rules are evaluated twice.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    both = F.transform(F.array(lines), lambda x: F.struct(x.alias("every"), F.filter(x, good_line).alias("good")))
    chars = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + F.length(y))
    made = F.transform(
        both,
        lambda s: F.struct(
            F.array_join(s["good"], "\n").alias("text"),
            F.size(s["every"]).cast("long").alias("n_lines"),
            F.size(s["good"]).cast("long").alias("n_kept"),
            chars(s["every"]).alias("n_chars"),
            chars(s["good"]).alias("n_left"),
        ),
    )
    return F.filter(made, lambda s: (s["n_left"] > 0) & (s["n_left"] >= s["n_chars"] * (1 - MAX_LOSS)))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that pass, with cleaned text and `n_chars` (where there is such a column) of that text.

    A null, empty or blank text has nothing to keep and is rejected. Each row is judged by itself, so
    repeated rows stay or go together; a null id changes nothing. All other columns stay as they are,
    whatever their names. Empty input gives an empty result.
    """
    own = _columns.numbered(docs)
    judged = own.select("*", F.explode(_judged(F.col(f"c{docs.columns.index(text_col)}"))).alias("judged"))
    new = {text_col: F.col("judged.text"), "n_chars": F.length("judged.text")}
    kept = [new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"c{i}") for i, c in enumerate(docs.columns)]
    return judged.select(*kept).toDF(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, text, n_lines, n_kept, n_chars, n_left)` of the documents that pass."""
    judged = docs.select(_columns.named(id_col).alias("doc_id"), F.explode(_judged(_columns.named(text_col))).alias("j"))
    return judged.select("doc_id", "j.*")
