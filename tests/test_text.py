import pytest
from pyspark.sql import functions as F

from quillion.functions import markers, narrative, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("path/to/file.py:42", "path to file py 42"),
        ("ΑΣ ς", "ασ ς"),
        ("  ", ""),
        ("a—b\tc\r\nd", "a b c d"),
    ],
)
def test_normalize(spark, raw, wanted):
    assert one(spark, raw, text.normalize) == wanted


@pytest.mark.parametrize("a, b", [("size > 0", "size 0"), ("a > b", "a < b"), ("x >= 1", "x > 1"), ("x != 0", "x = 0"), ("v > -1", "v > 1")])
def test_comparable_keeps_operators_apart(spark, a, b):
    assert one(spark, a, text.normalize_comparable) != one(spark, b, text.normalize_comparable)


@pytest.mark.parametrize(
    "a, b",
    [("size>0", "size   >   0"), ("> quoted words", "quoted words"), ("non-blocking", "non blocking"), ("the buffer!", "the buffer"), ("utf-8", "utf 8"), ("one\n# =====\ntwo", "one\n#\ntwo"), ("a\n<<<<<\nb", "a\nb"), ("a\n-----\nb", "a b")],
)
def test_comparable_drops_typography(spark, a, b):
    assert one(spark, a, text.normalize_comparable) == one(spark, b, text.normalize_comparable)


def test_shingles_of_few_words_are_none(spark):
    f = lambda c: text.shingles(text.words(c))
    assert one(spark, "a b", f) == []
    assert one(spark, "", f) == []
    assert one(spark, "a b c", f) == ["a b c"]
    assert one(spark, "a b a b a", f) == ["a b a", "b a b"]
    g = lambda c: text.corpus_shingles(text.words(c))
    assert one(spark, "a b", g) == ["a b"]
    assert one(spark, "", g) == []


def test_address_and_rounding(spark):
    df = spark.createDataFrame([("p.py", 3, 3), ("p.py", 3, 5)], "p string, a int, b int")
    assert [r[0] for r in df.select(text.address(F.col("p"), F.col("a"), F.col("b"))).collect()] == ["p.py:3", "p.py:3-5"]
    for score, wanted in ((13 / 16, "0.812"), (0.9, "0.900"), (20 / 24, "0.833"), (1.0, "1.000")):
        assert spark.range(1).select(text.half_even(F.lit(score))).first()[0] == wanted


def test_paths_sort_by_component(spark):
    df = spark.createDataFrame([("a-b.py",), ("a/b.py",), ("/x.py",), ("../x.py",), ("./x.py",)], "p string")
    assert [r[0] for r in df.orderBy(text.path_key(F.col("p"))).collect()] == ["/x.py", "./x.py", "../x.py", "a/b.py", "a-b.py"]


@pytest.mark.parametrize("w, s", [("increments", "increment"), ("counting", "count"), ("flies", "fli"), ("boxes", "box"), ("used", "used"), ("us", "us")])
def test_stem(spark, w, s):
    assert one(spark, w, text.stem) == s


TELLS = [
    ("Execute a task.\n\nArgs:\n    task: what to do\n    agent: who\n\nReturns:\n    a value\n", "Execute a task.\n\n"),
    ("Sends it.\n\n:param url: where\n    more of it\n:rtype: Response\nDone.\n", "Sends it.\n\nDone.\n"),
    ("Sum up.\n\nParameters\n----------\nrun : Run\n    The run.\n\nNotes\n-----\nAdvice only.\n", "Sum up.\n\nNotes\n-----\nAdvice only.\n"),
    (">>> f(1)\n... more\nout\n\nend\n", "out\n\nend\n"),
    (">>> f()\nArgs:\n    kept as it is printed\n\nend\n", "Args:\n    kept as it is printed\n\nend\n"),
    ("a\n```\ncode\n```\nb\n", "a\nb\n"),
]
STAYS = ["Note:\n    deep\n", "Arguments:\n    deep\n", "```\nnever closed\n", "Parameters\n---\nx\n", ":class:`X` is nice\n", ">>>text\n", ":return policy: none\n", "> quoted\n", "Usage\n-----\n"]


@pytest.mark.parametrize("raw, kept", TELLS)
def test_scaffolding_goes(raw, kept):
    assert narrative.kept_text(raw) == kept


@pytest.mark.parametrize("raw", STAYS)
def test_what_only_looks_like_scaffolding_stays(raw):
    assert narrative.kept_text(raw) == raw


def test_tabs_and_form_feeds():
    assert narrative.indent("\t x") == 9
    assert narrative.indent("    \f  x") == 2
    assert narrative.kept_text("A.\nArgs:\n\tx: y\nB.\n") == "A.\nB.\n"


def test_narrative_column_equals_the_function(spark):
    for raw, _ in TELLS:
        want = one(spark, narrative.kept_text(raw), text.normalize_comparable)
        assert one(spark, raw, narrative.narrative) == want


MARKS = ["# !TPX002", "# !TPX001,TPX002", "# !TPX*", "# !TPX002 reason", "  # !  TPX003,,x", "﻿# !TPX001", "# !tpx001", "# !TPX77,TPX001", "# !TPX001 TPX003"]
NONE = ["#!TPX002", "# !important: x", "# !HTTP2 is mandatory", "# !TPX0*", "# !", "x = 1", "", "# plain", "#  ! , "]


def test_markers(spark):
    assert markers.parse_marker("# !TPX001 TPX003")["codes"] == ["TPX001"]
    assert markers.parse_marker("# !tpx001") == {"all": False, "codes": [], "unknown": ["tpx001"]}
    assert all(markers.is_marker(m) for m in MARKS)
    assert not any(markers.is_marker(m) for m in NONE)
    df = spark.createDataFrame([(m,) for m in MARKS + NONE], "line string")
    for r in df.select("line", markers.suppression(F.col("line")).alias("s"), markers.near_miss(F.col("line")).alias("near")).collect():
        want = markers.parse_marker(r.line) or {"all": False, "codes": [], "unknown": []}
        assert r.s.asDict() == want, r.line
        assert r.near == markers.is_near_miss(r.line), r.line


def test_near_misses():
    for line in ("# !tpz001", "# see TPX001", "#!TPX002", "# tpx* maybe"):
        assert markers.is_near_miss(line), line
    assert not markers.is_near_miss("# !important")
    assert markers.is_near_miss("# oldname: NOQA", legacy=("oldname",)) and not markers.is_near_miss("# oldname: noqa")


def test_rounding_takes_the_double_for_what_it_is(spark):
    scores = [63 / 80, 69 / 80, 71 / 80, 77 / 80, 13 / 16, 15 / 16]
    got = spark.createDataFrame([(x,) for x in scores], "x double").select(text.half_even(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:.3f}" for x in scores] == ["0.787", "0.863", "0.887", "0.963", "0.812", "0.938"]
