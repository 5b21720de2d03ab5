"""Narrative text: prose without the scaffolding of an API reference.

A cursor walks the lines; every handler looks at one position and says how many lines to skip, or to copy
unread. The kept text is normalised by built-in expressions afterwards.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillion.functions.text import normalize_comparable

_GOOGLE = {f"{w}:" for w in ("Yields", "Returns", "Raises", "Keyword Args", "Attributes", "Args")}
_NUMPY = {"Yields", "Returns", "Raises", "Parameters", "Keyword Arguments", "Attributes"}
_BARE = {"rtype", "vartype"} | {w + s for w in ("return", "yield") for s in ("", "s")}
_FIELDS = _BARE | set("param parameter arg argument key keyword raise raises except exception type var ivar cvar".split())
_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_FIELD = re.compile(rf":([^:]*):(?:[{re.escape(_SPACE)}]|\Z)")


def lines_of(text: str) -> list[str]:
    """Lines as ended by a line feed, each without one carriage return at its end."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def _trim(s: str) -> str:
    return s.strip(_SPACE)


def _prompt(s: str, mark: str) -> bool:
    return s == mark or s.startswith(mark) and s[len(mark)] in _SPACE


def indent(line: str) -> int:
    width = 0
    for c in line:
        if c == "\t":
            width += 8 - width % 8
        elif c == "\f":
            width = 0
        elif c in _SPACE:
            width += 1
        else:
            break
    return width


def _underlined(lines: list[str], i: int) -> str | None:
    name = _trim(lines[i])
    if not name or i + 1 == len(lines):
        return None
    dashes = _trim(lines[i + 1])
    return name if dashes == "-" * len(name) and indent(lines[i + 1]) == indent(lines[i]) else None


def _body(lines: list[str], i: int, stop) -> int:
    while i < len(lines) and not stop(i):
        i += 1
    return i


def _skip(lines: list[str], i: int) -> int | None:
    """Where to go on behind scaffolding that begins at line `i`, if some does."""
    bare, depth = _trim(lines[i]), indent(lines[i])
    if bare.startswith("```"):
        close = _body(lines, i + 1, lambda j: _trim(lines[j]).startswith("```"))
        if close < len(lines):
            return close + 1
        return None
    deeper = lambda j: bool(_trim(lines[j])) and indent(lines[j]) <= depth
    if bare in _GOOGLE:
        return _body(lines, i + 1, deeper)
    name = _underlined(lines, i)
    if name is not None:
        if name not in _NUMPY:
            return None
        return _body(lines, i + 2, lambda j: bool(_trim(lines[j])) and indent(lines[j]) < depth or _underlined(lines, j) is not None)
    m = _FIELD.match(bare)
    if m:
        inside = m.group(1).split()
        if inside and inside[0] in _FIELDS and not (len(inside) > 1 and inside[0] in _BARE):
            return _body(lines, i + 1, deeper)
    return None


def kept_text(text: str) -> str:
    """The lines of `text` that tell something, each ended by a line feed."""
    lines, out, i = lines_of(text), [], 0
    while i < len(lines):
        if _prompt(_trim(lines[i]), ">>>"):
            shown = _body(lines, i + 1, lambda j: not any(_prompt(_trim(lines[j]), p) for p in (">>>", "...")))
            i = _body(lines, shown, lambda j: not _trim(lines[j]) or _trim(lines[j]).startswith(">>>"))
            out += lines[shown:i]
            continue
        after = _skip(lines, i)
        if after is None:
            out.append(lines[i])
            i += 1
        else:
            i = after
    return "".join(x + "\n" for x in out)


#: A text without any of these has no scaffolding, and need not go to Python.
MAYBE = r">>>|```|(?m)^\s*(Args|Attributes|Keyword Args|Raises|Returns|Yields):\s*$|^\s*-+\s*$|^\s*:[^:]*:(\s|$)"


@F.pandas_udf(StringType())
def _kept(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else kept_text(t))


def narrative(raw: Column) -> Column:
    """The comparison form of what `raw` tells; only texts that may have scaffolding leave the JVM."""
    return normalize_comparable(F.coalesce(_kept(F.when(raw.rlike(MAYBE), raw)), raw))
