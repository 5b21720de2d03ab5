"""The walk of source trees, on the driver: a listing is small, and its rules depend on every parent folder."""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.sources.config import CannotStart, Loaded
from quillion.sources.extract import is_python_name
from quillion.sources.ignore import Rules

NO_LINKS = "symlinks are not followed, so this file was not measured"
NOT_REGULAR = "not a regular file"


@dataclass
class Walked:
    """`(path as typed, canonical path, named)` of files; paths that `exclude` removed; `(path, reason)`."""

    files: list[tuple[str, str, bool]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)


def _chain(folder: Path) -> list[Rules]:
    """Ignore rules of a folder and all above it, the nearest last."""
    out = []
    for f in [*reversed(folder.parents), folder]:
        rules = Rules.of_files(f, f / ".git" / "info" / "exclude", f / ".gitignore", f / ".ignore")
        if rules:
            out.append(rules)
    return out


def _global() -> Rules | None:
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return Rules.of_files(Path("/"), Path(home) / "git" / "ignore")


def _ignored(chain: list[Rules], path: Path, folder: bool) -> bool:
    for rules in reversed(chain):
        v = rules.verdict(path, folder)
        if v is not None:
            return v
    return False


def walk(root: str, loaded: Loaded = Loaded()) -> Walked:
    """The Python files below `root`, or `root` itself if it is one."""
    out, top = Walked(), Path(root)
    if not top.exists():
        raise CannotStart(f"{root} does not exist")
    if top.is_file():
        if not is_python_name(top.name):
            raise CannotStart(f"{root} is no Python file")
        out.files.append((root, os.path.realpath(root), True))
        return out
    real = Path(os.path.realpath(root))
    base = loaded.source.parent if loaded.source else real
    exclude = Rules(base, list(loaded.config.exclude)) if loaded.config.exclude else None
    first = _global()

    def typed(path: Path) -> str:
        return os.path.join(root, os.path.relpath(path, real))

    def visit(folder: Path, chain: list[Rules]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            if folder == real:
                raise CannotStart(f"{root}: {e.strerror}") from None
            out.skipped.append((typed(folder), str(e.strerror)))
            return
        for e in entries:
            path = Path(e.path)
            folder_here = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or _ignored(chain, path, folder_here):
                continue
            if exclude and exclude.verdict(path, folder_here):
                if folder_here or is_python_name(e.name):
                    out.excluded.append(typed(path))
                continue
            if folder_here:
                own = Rules.of_files(path, path / ".gitignore", path / ".ignore")
                visit(path, [*chain, own] if own else chain)
            elif is_python_name(e.name):
                mode = os.lstat(path).st_mode
                if stat.S_ISREG(mode):
                    out.files.append((typed(path), os.path.realpath(path), False))
                else:
                    out.skipped.append((typed(path), NO_LINKS if stat.S_ISLNK(mode) else NOT_REGULAR))

    visit(real, ([first] if first else []) + _chain(real))
    return out


def merge(spark: SparkSession, walks: list[Walked]) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
    """Files of all roots, each once: a named file before a found one, then the order of roots."""
    rows = [(path, identity, named, i, j) for i, w in enumerate(walks) for j, (path, identity, named) in enumerate(w.files)]
    files = spark.createDataFrame(rows, "path string, identity string, is_explicit boolean, root int, place int")
    order = Window.partitionBy("identity").orderBy(F.desc("is_explicit"), "root", "place")
    once = files.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("path", "identity", "is_explicit")
    measured = {x[1] for x in rows}
    excluded = sorted({p for w in walks for p in w.excluded if os.path.realpath(p) not in measured})
    return once, excluded, sorted({s for w in walks for s in w.skipped})


def with_content(files: DataFrame) -> DataFrame:
    """`(path, content)`: files read where the tasks run, from a file system that all machines see."""
    import pandas as pd

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            rows = []
            for path, identity in zip(b["path"], b["identity"]):
                with open(identity, "rb") as f:
                    rows.append((path, f.read()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.repartition(parts, "identity").mapInPandas(read, "path string, content binary")
