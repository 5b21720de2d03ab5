"""Patterns of ignore files: anchoring, `**`, folders only, negation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    negated: bool
    folder_only: bool

    @classmethod
    def parse(cls, line: str) -> Pattern | None:
        """None for a blank line or comment; ValueError for a glob that can't be read."""
        s = line.rstrip("\r\n")
        if s.startswith("#"):
            return None
        while s.endswith(" ") and not s.endswith("\\ "):
            s = s[:-1]
        if not s:
            return None
        negated = s.startswith("!")
        s = s[negated:]
        if s.startswith(("\\#", "\\!")):
            s = s[1:]
        folder = s.endswith("/")
        s = s.rstrip("/") if folder else s
        anchored = "/" in s
        s = s.lstrip("/")
        if not s:
            return None
        return cls(re.compile(("" if anchored else "(?:.*/)?") + _regex(s) + r"\Z", re.S), negated, folder)

    def matches(self, relative: str, folder: bool) -> bool:
        return (folder or not self.folder_only) and self.regex.match(relative) is not None


def _regex(glob: str) -> str:
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            if j - i == 2 and (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/"):
                if j == n:
                    out += ".*"
                else:
                    out += "(?:.*/)?"
                    j += 1
            else:
                out += "[^/]*"
            i = j
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[":
            j = glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("!", "^") else 2))
            if j < 0:
                raise ValueError("unclosed character class")
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = j
        elif c == "{":
            j = glob.find("}", i)
            if j < 0:
                raise ValueError("unclosed alternatives")
            out += "(?:" + "|".join(_regex(x) for x in glob[i + 1 : j].split(",")) + ")"
            i = j
        elif c == "\\" and i + 1 < n:
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


class Rules:
    """The patterns of one folder, tried from the last to the first."""

    def __init__(self, base: Path, lines: list[str]):
        self.base = base
        self.patterns = []
        for line in lines:
            try:
                p = Pattern.parse(line)
            except ValueError:
                continue
            if p:
                self.patterns.append(p)

    @classmethod
    def of_files(cls, base: Path, *paths: Path) -> Rules | None:
        lines: list[str] = []
        for p in paths:
            try:
                lines += p.read_text("utf-8", "replace").splitlines()
            except OSError:
                continue
        return cls(base, lines) if lines else None

    def verdict(self, path: Path, folder: bool) -> bool | None:
        """True if ignored, False if taken back, None if no pattern speaks of it."""
        try:
            relative = path.relative_to(self.base).as_posix()
        except ValueError:
            return None
        for p in reversed(self.patterns):
            if p.matches(relative, folder):
                return not p.negated
        return None
