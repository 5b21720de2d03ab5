import json
import os

import pytest

from quillion.cli import main, parse
from quillion.plans.report import check
from quillion.sources.config import CannotStart, from_document, load, normalise_glob
from quillion.sources.ignore import Pattern
from quillion.sources.walk import NO_LINKS, NOT_REGULAR, merge, walk

TEXT = "\n".join(f"# {line}" for line in ("this explains in some words", "how the retries of a request", "are counted and when they end"))
LONG = "# " + " ".join(f"w{i}" for i in range(170)) + "\n"


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def names(walked, root):
    return sorted(os.path.relpath(f[0], root) for f in walked.files)


def test_walk(tmp_path):
    put(tmp_path, {".gitignore": "built/\n*.gen.py\n!keep.gen.py\n/top.py\n", "a.py": "", "LOUD.PY": "", "n.pyi": "", ".hidden.py": "", "__init__.py": "", "_p.py": "", "built/x.py": "", "s/b.gen.py": "", "s/keep.gen.py": "", "top.py": "", "s/top.py": "", "dir.py/in.py": "", "s/.gitignore": "q*\n", "s/qq.py": ""})
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    os.mkfifo(tmp_path / "pipe.py")
    w = walk(str(tmp_path))
    assert names(w, tmp_path) == sorted(["a.py", "LOUD.PY", "__init__.py", "_p.py", "s/keep.gen.py", "s/top.py", "dir.py/in.py"])
    assert sorted((os.path.basename(p), r) for p, r in w.skipped) == [("link.py", NO_LINKS), ("pipe.py", NOT_REGULAR)]
    with pytest.raises(CannotStart):
        walk(str(tmp_path / "none"))
    with pytest.raises(CannotStart):
        walk(str(tmp_path / "n.pyi"))


def test_exclude_and_merge(spark, tmp_path):
    put(tmp_path, {"pyproject.toml": '[tool.quillion]\nexclude = ["vendor", "./gen", "old/"]\n', "vendor/a.py": "", "x/vendor/b.py": "", "gen/c.py": "", "x/gen/d.py": "", "old/e.py": "", "x/old/f.py": "", "g.py": ""})
    w = walk(str(tmp_path), load(tmp_path))
    assert names(w, tmp_path) == ["g.py", "x/gen/d.py", "x/old/f.py"]
    assert sorted(os.path.relpath(p, tmp_path) for p in w.excluded) == ["gen", "old", "vendor", "x/vendor"]
    named = walk(str(tmp_path / "g.py"))
    files, excluded, _ = merge(spark, [w, named])
    got = {r.path: r.is_explicit for r in files.collect()}
    assert got[str(tmp_path / "g.py")] is True and len(got) == 3 and len(excluded) == 4


@pytest.mark.parametrize("bad", ["", "  ", "/", "/x", "../x", "!x", "./!x", "a\\b", "[x", ".", "a/../b"])
def test_bad_globs(bad):
    with pytest.raises(CannotStart):
        normalise_glob(bad)


def test_globs():
    assert [normalise_glob(g) for g in ("vendor", "vendor/", "./vendor", "a//b", "**/x")] == ["vendor", "/vendor/", "/vendor", "a/b", "**/x"]
    assert Pattern.parse("a/**/b").matches("a/x/y/b", False) and Pattern.parse("a/**/b").matches("a/b", False)
    assert not Pattern.parse("a*b").matches("a/b", False) and Pattern.parse("[!a]x").matches("bx", False)


@pytest.mark.parametrize(
    "table", [{"nope": 1}, {"ignore": "TPX001"}, {"ignore": ["TPX009"]}, {"ignore": [1]}, {"comment-max-volume": -1}, {"comment-max-volume": "9"}, {"docstring-max-volume": True}, {"exclude": "x"}]
)
def test_bad_configuration(table):
    with pytest.raises(CannotStart):
        from_document({"tool": {"quillion": table}})


def test_configuration():
    assert from_document({}) is None and from_document({"tool": {}}) is None
    c = from_document({"tool": {"quillion": {"ignore": ["TPX003", "TPX001", "TPX003"], "comment-max-volume": 0}}})
    assert c.ignore == ("TPX001", "TPX003") and c.comment_max == 0 and c.docstring_max == 200
    with pytest.raises(CannotStart):
        from_document({"tool": 3})


def test_a_whole_run(spark, tmp_path, capsys):
    put(tmp_path, {"a.py": TEXT + "\n", "b.py": "x = 1\n" + TEXT + "\n", "c.py": LONG, "d.py": "# !TPX001\n" + LONG, "bad.py": "def (:\n", "e.py": "# !TPX9,TPX001\n" + LONG, "f.py": "y = 2\n"})
    r = check(spark, [str(tmp_path)])
    assert [(f["code"], os.path.basename(f["path"])) for f in r.findings] == [("TPX003", "a.py"), ("TPX001", "c.py")]
    assert not r.complete and r.status == 1 and any("`TPX9`" in w for w in r.warnings)
    doc = json.loads(r.to_json())
    assert list(doc) == ["schema_version", "complete", "skipped", "excluded", "findings"] and doc["schema_version"] == "2"
    assert list(doc["findings"][0]) == ["code", "path", "line", "end_line", "prose_kind", "message", "locations", "weakest"]
    assert list(doc["findings"][1])[-2:] == ["words", "max_volume"]
    assert r.to_text().splitlines()[-1] == "Found 2 findings (TPX001: 1, TPX003: 1); check incomplete: 1 file skipped."
    (tmp_path / "clean").mkdir()
    (tmp_path / "clean" / "x.py").write_text("# short\n")
    assert main(["check", str(tmp_path / "clean")], spark) == 0
    assert capsys.readouterr().out == "All checks passed!\n"
    assert main(["check", str(tmp_path / "none")], spark) == 2


def test_arguments(capsys):
    assert parse(["check", "a", "b", "--format=json"]).format == "json"
    for bad in ([], ["lint"], ["check"], ["check", "a", "--format"], ["check", "a", "--format", "xml"], ["check", "a", "--x"], ["check", "a", "--format", "json", "--format=text"], ["--rules", "x"]):
        with pytest.raises(CannotStart):
            parse(bad)
    assert main(["--rules"]) == 0 and capsys.readouterr().out.startswith("TPX001  Released     ")
