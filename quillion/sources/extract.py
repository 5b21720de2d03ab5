"""Prose blocks of Python sources: docstrings and runs of comments."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions.markers import is_marker
from quillion.functions.narrative import lines_of, narrative
from quillion.functions.text import kind_rank, normalize, size_lines, size_words

_COOKIE = re.compile(r"coding[:=][ \t]*[-_.a-zA-Z0-9]")
_HOLDERS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


class NotMeasured(Exception):
    """A source that can't be read; its text says why."""


def is_python_name(name: str) -> bool:
    """Whether a file name has a stem and the extension `py` in any case."""
    stem, dot, ext = name.rpartition(".")
    return bool(dot and stem) and ext.lower() == "py"


def is_pragma(text: str, line: int) -> bool:
    """A comment for tools: a shebang, an encoding cookie, `noqa`, a type comment, a marker."""
    if line == 1 and text.startswith("#!"):
        return True
    body = text.lstrip("#").lstrip()
    if line <= 2 and _COOKIE.search(body):
        return True
    return body.lower().startswith(("noqa", "type:")) or is_marker(text)


def _docstrings(tree: ast.Module) -> Iterator[ast.Constant]:
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, *_HOLDERS)) and node.body and isinstance(node.body[0], ast.Expr):
            value = node.body[0].value
            if isinstance(value, ast.Constant) and isinstance(value.value, str):
                yield value


def extract(path: str, source: str) -> list[tuple[str, int, int, str]]:
    """`(kind, first line, last line, raw)` of every block, in order of lines, docstrings first.

    Raises `NotMeasured` for another kind of file, or one that doesn't parse.
    """
    if not is_python_name(path.rpartition("/")[2]):
        raise NotMeasured("not a Python source")
    text = source.removeprefix("\ufeff")
    try:
        tree = ast.parse(text)
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as e:
        raise NotMeasured(f"could not parse: {e}") from None
    lines = text.split("\n")
    out = [("docstring", v.lineno, v.end_lineno, ast.get_source_segment(text, v)) for v in _docstrings(tree)]
    run: list[tokenize.TokenInfo] = []

    def close():
        if run:
            (a, col), (z, end) = run[0].start, run[-1].end
            raw = lines[a - 1 : z]
            raw[-1] = raw[-1][:end]
            raw[0] = raw[0][col:]
            out.append(("comment", a, z, "\n".join(raw)))
            run.clear()

    for t in tokens:
        if is_pragma(t.string, t.start[0]) or t.line[: t.start[1]].strip():
            continue
        if run and t.start[0] != run[-1].start[0] + 1:
            close()
        run.append(t)
    close()
    return sorted(out, key=lambda b: (b[1], b[2], b[0] != "docstring"))


_ROWS = "path string, reason string, kind string, line_start int, line_end int, raw string, line_above string, first_line string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                source = bytes(content).decode("utf-8")
                found = extract(path, source)
            except UnicodeDecodeError:
                rows.append((path, "not valid UTF-8", None, None, None, None, None, None))
                continue
            except NotMeasured as e:
                rows.append((path, str(e), None, None, None, None, None, None))
                continue
            lines = lines_of(source) if found else []
            at = lambda n: lines[n] if 0 <= n < len(lines) else None  # noqa: B023, E731
            rows += [(path, None, kind, a, z, raw, at(a - 2), at(a - 1)) for kind, a, z, raw in found]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")]).astype({"line_start": "Int32", "line_end": "Int32"})


def read_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(blocks, skipped)` of `files(path, content)`. One unreadable file is a row of `skipped`, never an error."""
    rows = files.select("path", "content").mapInPandas(_read, _ROWS)
    return with_sizes(rows.where("reason is null").drop("reason")), rows.where("reason is not null").select("path", "reason")


def with_sizes(blocks: DataFrame) -> DataFrame:
    """Blocks with their normal forms and sizes. The narrative is lazy: a plan that doesn't use it never runs it."""
    return (
        blocks.withColumn("kind_rank", kind_rank(F.col("kind")))
        .withColumn("normalized", normalize(F.col("raw")))
        .withColumn("size_lines", size_lines(F.col("line_start"), F.col("line_end")))
        .withColumn("size_words", size_words(F.col("normalized")))
        .withColumn("narrative", narrative(F.col("raw")))
    )
