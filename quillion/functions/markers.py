"""The suppression language: `# !CODE[,CODE...] reason` on the line above a block."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CODES = ("TPX001", "TPX002", "TPX003")
SPACE = "TPX"
ALL = SPACE + "*"
_WS = r"[ \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BODY = re.compile(rf"\ufeff*{_WS}*#(.*)", re.S)
_BANG = re.compile(rf"{_WS}+!{_WS}*(\S+)")
_CODE = re.compile(rf"{SPACE}[0-9]+", re.I)
_NEAR = re.compile(rf"{SPACE}[0-9*]", re.I)


def parse_marker(line: str) -> dict | None:
    """`{"all", "codes", "unknown"}` of a marker line, or None."""
    body = _BODY.match(line)
    m = body and _BANG.match(body.group(1))
    listed = [x for x in m.group(1).split(",") if x] if m else []
    if not listed or not (listed[0] == ALL or _CODE.fullmatch(listed[0])):
        return None
    rest = [x for x in listed if x != ALL]
    return {"all": ALL in listed, "codes": [x for x in rest if x in CODES], "unknown": [x for x in rest if x not in CODES]}


def is_marker(line: str) -> bool:
    return parse_marker(line) is not None


def is_near_miss(line: str, legacy: tuple[str, ...] = ()) -> bool:
    """Whether a line was probably meant as a marker. `legacy` lists names of older tools, as in `# name: noqa`."""
    body = _BODY.match(line)
    if not body or is_marker(line):
        return False
    m = _BANG.match(body.group(1))
    first = next((x for x in m.group(1).split(",") if x), "") if m else ""
    if first[:2].lower() == "tp" or _NEAR.search(body.group(1)):
        return True
    return any(re.match(rf"{_WS}*{re.escape(n)}{_WS}*:{_WS}*[nN][oO][qQ][aA]", body.group(1)) for n in legacy)


def _listed(line: Column) -> Column:
    """Tokens of a marker's code list, for any comment with a bang."""
    return F.filter(F.split(F.regexp_extract(line, r"^\x{FEFF}*\s*#\s+!\s*(\S+)", 1), ","), lambda x: x != "")


def suppression(line: Column) -> Column:
    """`struct<all, codes, unknown>` of the line above a block; a line that is no marker suppresses nothing."""
    listed = _listed(F.coalesce(line, F.lit("")))
    first = F.get(listed, 0)
    marker = F.coalesce((first == ALL) | first.rlike(f"(?i)^{SPACE}[0-9]+$"), F.lit(False))
    own = F.when(marker, listed).otherwise(F.array().cast("array<string>"))
    known = F.array(*map(F.lit, CODES))
    return F.struct(
        F.array_contains(own, ALL).alias("all"),
        F.filter(own, lambda x: F.array_contains(known, x)).alias("codes"),
        F.filter(own, lambda x: ~F.array_contains(known, x) & (x != ALL)).alias("unknown"),
    )


def silenced(supp: Column, code: Column | str) -> Column:
    return supp["all"] | F.array_contains(supp["codes"], code)


def near_miss(line: Column) -> Column:
    """`is_near_miss` as built-in expressions, without older names."""
    line = F.coalesce(line, F.lit(""))
    s = suppression(line)
    marker = s["all"] | (F.size(s["codes"]) > 0) | (F.size(s["unknown"]) > 0)
    comment = line.rlike(r"^\x{FEFF}*\s*#")
    aimed = F.coalesce(F.get(_listed(line), 0).rlike("(?i)^tp"), F.lit(False))
    return comment & ~marker & (aimed | line.rlike(rf"(?i)^\x{{FEFF}}*\s*#.*{SPACE}[0-9*]"))
