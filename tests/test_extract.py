import pytest

from quillion.sources.extract import NotMeasured, extract, is_pragma, is_python_name, read_sources

SOURCE = '''#!/usr/bin/env python
# -*- coding: utf-8 -*-
"""Module text,
two lines."""

# one comment
# runs on

x = 1  # trailing
# noqa: all of it
# type: ignore
# a b

class A:
    r"""Raw class text."""

    def f(self):
        ("joined " "text")
        if x:
            def g():
                """Deep."""
    async def h(self):
        f"""no docstring"""
        # inside
            # deeper
'''


def test_blocks_of_a_source():
    got = [(k, a, z) for k, a, z, _ in extract("a/s.py", SOURCE)]
    assert got == [("docstring", 3, 4), ("comment", 6, 7), ("comment", 12, 12), ("docstring", 15, 15), ("docstring", 18, 18), ("docstring", 21, 21), ("comment", 24, 25)]
    raw = {a: r for _, a, _, r in extract("s.py", SOURCE)}
    assert raw[15] == 'r"""Raw class text."""' and raw[18] == '"joined " "text"' and raw[24] == "# inside\n            # deeper"


@pytest.mark.parametrize("text, line, wanted", [("#!x", 1, True), ("#!x", 2, False), ("# coding=utf-8", 2, True), ("# coding=utf-8", 3, False), ("# coding:", 1, False), ("## NoQA", 9, True), ("#type: int", 9, True), ("# typed", 9, False), ("# !TPX001", 9, True)])
def test_pragmas(text, line, wanted):
    assert is_pragma(text, line) is wanted


def test_names_and_errors():
    assert [is_python_name(n) for n in ("a.py", "LOUD.PY", "a.pyi", ".py", "py", "a.b.py")] == [True, True, False, False, False, True]
    with pytest.raises(NotMeasured):
        extract("a.txt", "")
    with pytest.raises(NotMeasured):
        extract("a.py", "def (:\n")


def test_an_unreadable_file_is_a_row(spark):
    rows = [("ok.py", b"# some words\n# more words\n"), ("bad.py", b"def (:"), ("latin.py", b"# \xff\n"), ("bom.py", b"\xef\xbb\xbf# !TPX001\n# long text\n")]
    blocks, skipped = read_sources(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path for r in skipped.collect()} == {"bad.py", "latin.py"}
    got = {(r.path, r.line_start, r.line_above) for r in blocks.collect()}
    assert got == {("ok.py", 1, None), ("bom.py", 2, "﻿# !TPX001")}


def test_queries_read_every_document_and_whole_lines(spark, tmp_path):
    from quillion import queries

    long = "one shared explanation of nine words stands here twice"
    texts = ["# Heading\ntext", "#!/bin/sh\necho", "noqa: a\nplain", "a\ntype: b\nc", "!TPX003 why\nrest", None, "plain"]
    texts += ["x" * 40 + "\n  # !TPX001,TPX9 " + "y" * 40, "a line of twenty and # !TPX003", "# see here what is far away TPX003", f"# !TPX003\n{long}", f"{long}\nagain and again", f"{long}\nagain and again"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.path, r.line_start, r.line_end, r.normalized) for r in queries.queries()["extract_blocks"](spark, str(tmp_path)).collect())
    want = []
    for i, t in enumerate(texts):
        run = []
        for n, line in enumerate([*([] if t is None else t.split("\n")), None], 1):
            if line is None or line.lower().startswith(("noqa", "type:")) or line.startswith("!TPX"):
                if run:
                    words = "".join(c.lower() if c.isalnum() else " " for c in " ".join(x for _, x in run)).split()
                    want.append((f"s/doc_{i}.py", run[0][0], run[-1][0], " ".join(words)))
                run = []
            else:
                run.append((n, line))
    assert got == sorted(want)
    found = {(r.doc_id, r.line): (r.all, r.codes, r.unknown, r.near_miss) for r in queries.queries()["document_markers"](spark, str(tmp_path)).collect()}
    assert found == {(7, 2): (False, "TPX001", "TPX9", False), (9, 1): (False, "", "", True), (10, 1): (False, "TPX003", "", False)}
    silent = queries.queries()["marked_clusters"](spark, str(tmp_path)).collect()
    assert [(r["first"], r.members) for r in silent] == [("s/doc_11.py", 2)]


def test_restatements(spark):
    from quillion.sources import restatement

    source = """# increment the counters
counter_increment += 1
# print(df, file_path)

print(df, file_path)
# source / destination
copy(source, destination)
# why this is here at all
x = 1  # x trailing
def f():
    # retry limits
    r'Doc.'
    # noqa: retry limit
    return retry_limit
# last words nowhere
"""
    n, hits = restatement.restatements(source)
    assert n == 7
    assert [(a, c, k) for a, _, c, k in hits] == [(1, "counter_increment += 1", False), (3, "print(df, file_path)", True), (6, "copy(source, destination)", False), (11, "return retry_limit", False), (13, "return retry_limit", False)]
    like = {"if lock:": True, "config.retry_limit": True, "a / b": False, "plain words here": False, "x = 1": True, "": False, "f(x)": True, "a[0]": True}
    assert {k: restatement.looks_like_code(k) for k in like} == like
    files = spark.createDataFrame([("a.py", bytearray(source.encode())), ("b.py", bytearray(b"def (")), ("c.py", None), ("d.py", bytearray(b"# a\n"))], "path string, content binary")
    assert sorted(r.line for r in restatement.find(files).collect()) == [1, 3, 6, 11, 13]
    assert tuple(restatement.rate(files).first()) == (8, 5, 1, 625.0) and tuple(restatement.rate(files.limit(0)).first()) == (0, 0, 0, 0.0)
