"""Project configuration: the nearest `pyproject.toml` upward, four keys, nothing else."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from quillion.functions.markers import CODES
from quillion.operators.findings import Config
from quillion.sources.ignore import Pattern

FILE = "pyproject.toml"
TABLE = "quillion"


class CannotStart(Exception):
    """The run can't begin: exit code 2."""


@dataclass(frozen=True)
class Loaded:
    config: Config = Config()
    source: Path | None = None


def discover(target: Path) -> Path | None:
    try:
        at = target.resolve(strict=True)
    except OSError:
        return None
    for folder in [at, *at.parents] if at.is_dir() else at.parents:
        if (folder / FILE).is_file():
            return folder / FILE
    return None


def _texts(key: str, value) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise CannotStart(f"`{key}` must be an array of strings")
    return value


def _limit(key: str, value) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise CannotStart(f"`{key}` must be a whole number of words, not {value!r}")
    return value


def normalise_glob(raw: str) -> str:
    """A glob in the form that the walk matches: `x` at any depth, `/x/` a folder and `/x` an entry of the base."""
    glob = raw.strip()
    parts, dotted = [], False
    for p in glob.split("/"):
        if p == "..":
            raise CannotStart(f"`exclude`: `{raw}` leaves the configuration's folder")
        if p == ".":
            dotted = dotted or not parts
        elif p:
            parts.append(p)
    if not parts:
        raise CannotStart(f"`exclude`: `{raw}` names no path and would exclude everything")
    if glob.startswith("/"):
        raise CannotStart(f"`exclude`: `{raw}` has a leading slash; write `./{glob.lstrip('/')}`")
    out = "/".join(parts)
    if out.startswith("!"):
        raise CannotStart(f"`exclude`: `{raw}` is negated, but entries can only exclude")
    if "\\" in out:
        raise CannotStart(f"`exclude`: `{raw}` has a backslash; paths are written with `/`")
    folder = glob.endswith("/")
    out = ("/" if dotted or folder else "") + out + ("/" if folder else "")
    try:
        Pattern.parse(out)
    except ValueError as e:
        raise CannotStart(f"`exclude`: `{raw}` is no valid glob: {e}") from None
    return out


def from_document(document: dict, table_name: str = TABLE) -> Config | None:
    """The configuration in a parsed document, None if it has none of ours."""
    table = document
    for key in ("tool", table_name):
        if key not in table:
            return None
        table = table[key]
        if not isinstance(table, dict):
            raise CannotStart(f"`{key}` must be a table")
    known = {"ignore", "exclude", "comment-max-volume", "docstring-max-volume"}
    for key in table:
        if key not in known:
            raise CannotStart(f"unknown key `{key}`; known are {', '.join(sorted(known))}")
    ignore = _texts("ignore", table.get("ignore", []))
    for code in ignore:
        if code not in CODES:
            raise CannotStart(f"`ignore`: `{code}` is no rule")
    default = Config()
    return Config(
        comment_max=_limit("comment-max-volume", table.get("comment-max-volume", default.comment_max)),
        docstring_max=_limit("docstring-max-volume", table.get("docstring-max-volume", default.docstring_max)),
        ignore=tuple(sorted(set(ignore))),
        exclude=tuple(map(normalise_glob, _texts("exclude", table.get("exclude", [])))),
    )


def load(target: Path, table_name: str = TABLE) -> Loaded:
    path = discover(target)
    if path is None:
        return Loaded()
    try:
        document = tomllib.loads(path.read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise CannotStart(f"{path}: {e}") from None
    config = from_document(document, table_name)
    return Loaded() if config is None else Loaded(config, path)


def load_all(targets: list[Path], table_name: str = TABLE) -> Loaded:
    """The one configuration of all targets; it's an error if they have different ones."""
    if not targets:
        raise CannotStart("check needs a path")
    first = load(targets[0], table_name)
    for t in targets[1:]:
        if load(t, table_name).source != first.source:
            raise CannotStart(f"{targets[0]} and {t} have different configurations")
    return first
