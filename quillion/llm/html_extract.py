"""Main text of web pages by two-pass block rules (operator 1).

A page becomes a list of blocks, cut at block-level tags. The first pass looks at each block by itself: its
length, the share of its characters in links, and the density of stop words of the page's language make it
good, bad, nearly good, or too short to tell. The second pass decides the ambiguous ones from
the nearest decided blocks before and behind. Text is joined from the good blocks.
"""

from __future__ import annotations

import functools
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINK_DENSITY = 0.2
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.18
MAX_HEADING_DISTANCE = 200

_STOP = {
    "en": "the of and to in a is that for it was on are as with he be by at from this have or had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has her two like him see no way could people than been who its now over did down only may after also any our even most you i they his".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde ich wenn kann sehr ihre".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme on ou nous sa cette ont aux ses été leur tout elle fait je être deux même d l à".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante son fue está ser".split(),
}
_ANY = frozenset(w for v in _STOP.values() for w in v)
_STOPS = {k: frozenset(v) for k, v in _STOP.items()}

#: What goes up to its end tag, or to the end of the page, whatever looks like a tag in it.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>")
_BLOCKS = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_BODY = "|".join(sorted(_BLOCKS - {"head", "html", "title"}))
_HEAD = re.compile(rf"<head(?![\w-]){_ATTRS}>", re.I)
_HEAD_ENDS = re.compile(rf"(</head\s*>)|<(?:{_BODY})(?![\w-])", re.I)
_HEAD_HOLDS = re.compile(rf"(?:\s|<title(?![\w-]){_ATTRS}>[^<]*(?:</title\s*>)?|</?(?:base|basefont|bgsound|link|meta)(?![\w-]){_ATTRS}>)*", re.I)
_MAY_GO = re.compile(r"<(?:noscript|template|svg|select)(?![\w-])", re.I)
_GOES = re.compile(rf"<(/?)(noscript|template|svg|select|foreignobject|{_BODY})(?![\w-]){_ATTRS}>", re.I)
_NEVER = frozenset("nav footer aside menu form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)


def _without_hidden(html: str) -> str:
    """`html` without what is in noscript, template, svg and select.

    One without its end tag loses the tag only; an svg ends at the first block that can't be in it, and may close itself.
    """
    if not _MAY_GO.search(html):
        return html
    open_: dict[str, list[int]] = {"noscript": [], "template": [], "svg": [], "select": []}
    gone: list[tuple[int, int]] = []
    foreign = 0
    for m in _GOES.finditer(html):
        name = m.group(2).lower()
        if name == "foreignobject":
            foreign = max(0, foreign + (-1 if m.group(1) else 1)) if open_["svg"] else 0
        elif name not in open_:
            if open_["svg"] and not foreign:
                gone.append((open_["svg"][0], m.start()))
                open_["svg"] = []
        elif m.group(1):
            if open_[name]:
                gone.append((open_[name].pop(), m.end()))
            if name == "svg" and not open_[name]:
                foreign = 0
        elif name == "svg" and m.group().endswith("/>"):
            gone.append(m.span())
        elif name in ("svg", "template"):
            open_[name].append(m.start())
        else:
            open_[name] = [m.start()]
    parts, at = [], 0
    for a, b in sorted(gone):
        if b > at:
            parts += [html[at : max(a, at)], " "]
            at = b
    return "".join(parts) + html[at:]


def _without_head(html: str) -> str:
    """`html` without its head, which ends at its end tag or, if that is left out, where the body begins."""
    m = _HEAD.search(html)
    if not m:
        return html
    end = _HEAD_ENDS.search(html, m.end())
    to = end.end() if end and end.group(1) else _HEAD_HOLDS.match(html, m.end()).end()
    return html[: m.start()] + " " + html[to:]


def blocks(html: str) -> list[tuple[str, int, bool, bool]]:
    """`(text, characters in links, is heading, in boilerplate tag)` of each non-empty block, in order."""
    html = _without_head(_without_hidden(_RAW.sub(" ", html)))
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = links = heading = never = at = 0

    def close():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, min(linked, len(text)), heading > 0, never > 0))
            parts.clear()
        linked = 0

    for m in _TAG.finditer(html):
        if m.start() > at:
            s = html[at : m.start()]
            parts.append(s)
            if links:
                linked += len(s)
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        step = -1 if m.group(1) else 1
        if name == "a":
            links = max(0, links + step)
        elif name in _BLOCKS:
            close()
            links = 0
            if name in _NEVER:
                never = max(0, never + step)
            elif name in _HEADINGS:
                heading = max(0, heading + step)
    if at < len(html):
        parts.append(html[at:])
        if links:
            linked += len(html) - at
    close()
    return out


def first_pass(text: str, linked: int, never: bool, stops: frozenset) -> str:
    n = len(text)
    if never or linked > MAX_LINK_DENSITY * n:
        return "bad"
    if "©" in text and n < LONG:
        return "bad"
    if n < SHORT:
        return "bad" if linked else "short"
    words = text.lower().split()
    share = sum(w.strip(".,;:!?\"'()") in stops for w in words) / len(words)
    if share >= STOP_HIGH:
        return "good" if n > LONG else "near"
    return "near" if share >= STOP_LOW else "bad"


def second_pass(kinds: list[str], lengths: list[int], headings: list[bool]) -> list[bool]:
    """Whether each block is kept: `short` and `near` blocks follow their nearest decided neighbours."""
    n = len(kinds)

    def nearest(order, near_counts):
        out, seen = [""] * n, "bad"
        for i in order:
            out[i] = seen
            if kinds[i] in ("good", "bad") or near_counts and kinds[i] == "near":
                seen = "bad" if kinds[i] == "bad" else "good" if kinds[i] == "good" else "near"
        return out

    before, behind = nearest(range(n), False), nearest(range(n - 1, -1, -1), False)
    before_n, behind_n = nearest(range(n), True), nearest(range(n - 1, -1, -1), True)
    done = list(kinds)
    for i, k in enumerate(kinds):
        if k == "short":
            a, b = before[i], behind[i]
            if a == b:
                done[i] = a
            else:  # between a good and a bad one: good if a nearly good one stands on the bad side
                done[i] = "good" if (a == "bad" and before_n[i] == "near") or (b == "bad" and behind_n[i] == "near") else "bad"
        elif k == "near":
            done[i] = "bad" if before[i] == "bad" and behind[i] == "bad" else "good"
    for i, h in enumerate(headings):  # a heading close above a good block belongs to it
        if h and done[i] != "good" and kinds[i] in ("short", "near"):
            far = 0
            for j in range(i + 1, n):
                if far > MAX_HEADING_DISTANCE:
                    break
                if done[j] == "good":
                    done[i] = "good"
                    break
                far += lengths[j]
    return [k == "good" for k in done]


@functools.lru_cache(maxsize=16)
def _stops(lang: str | None) -> frozenset:
    return _STOPS.get(lang or "", _ANY)


def extract(html: str) -> tuple[str, int, int]:
    """Main text, number of blocks, and number kept."""
    html = _RAW.sub(" ", html)
    m = _LANG.search(html)
    stops = _stops(m.group(1).lower() if m else None)
    found = blocks(html)
    kinds = [first_pass(t, linked, never, stops) for t, linked, _, never in found]
    keep = second_pass(kinds, [len(t) for t, *_ in found], [h for _, _, h, _ in found])
    return "\n".join(b[0] for b, k in zip(found, keep) if k), len(found), sum(keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """`(page_id, text, n_blocks, n_kept)`, one row for each row of `pages`.

    A null page gives a null text and no blocks; an empty page, or one without a good block, an empty text.
    Null ids are kept, repeated rows give repeated rows, and long pages are read whole. Other columns, of whatever
    name, are not read. Empty input gives an empty result.
    """

    def run(it):
        for batch in it:
            rows = [(None, 0, 0) if h is None else extract(h) for h in batch.column(1).to_pylist()]
            text, n, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "n_blocks", "n_kept"])

    some = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return some.mapInArrow(run, "page_id long, text string, n_blocks int, n_kept int")
