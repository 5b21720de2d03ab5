"""`python -m quillion.cli check PATH... [--format text|json]`, `--rules`, `--help`, `--version`."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

from quillion.plans.report import CANNOT_START, CLEAN, RULES, check
from quillion.sources.config import CannotStart

VERSION = "0.1.0"


@dataclass
class Arguments:
    action: str = "check"
    paths: list[str] = field(default_factory=list)
    format: str = "text"


def parse(argv: list[str]) -> Arguments:
    if not argv:
        raise CannotStart("expected a subcommand")
    first, rest = argv[0], list(argv[1:])
    if first in ("-h", "--help"):
        return Arguments("help")
    if first in ("-V", "--version", "--rules"):
        if rest:
            raise CannotStart(f"`{first}` takes no other arguments; got `{rest[0]}`")
        return Arguments("rules" if first == "--rules" else "version")
    if first != "check":
        raise CannotStart(f"unknown subcommand `{first}`")
    out, chosen = Arguments(), None
    while rest:
        a = rest.pop(0)
        if a in ("-h", "--help"):
            return Arguments("help")
        if a == "--format" or a.startswith("--format="):
            if a == "--format" and not rest:
                raise CannotStart("`--format` needs a value")
            value = rest.pop(0) if a == "--format" else a.partition("=")[2]
            if value not in ("text", "json"):
                raise CannotStart(f"unknown format `{value}`; expected `text` or `json`")
            if chosen:
                raise CannotStart("`--format` was given more than once")
            chosen = value
        elif a.startswith("-"):
            raise CannotStart(f"unknown option `{a}`")
        else:
            out.paths.append(a)
    if not out.paths:
        raise CannotStart("check needs a path")
    out.format = chosen or "text"
    return out


def rules_listing() -> str:
    return "".join(f"{code:<8}{'Released':<13}{what}\n" for code, what in RULES.items())


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parse(sys.argv[1:] if argv is None else argv)
        if args.action == "version":
            print(f"quillion {VERSION}")
        elif args.action == "rules":
            print(rules_listing(), end="")
        elif args.action == "help":
            print((__doc__ or "") + "\n\nRules:\n" + rules_listing(), end="")
        else:
            if spark is None:
                from pyspark.sql import SparkSession

                spark = SparkSession.builder.appName("quillion").getOrCreate()
            report = check(spark, args.paths)
            for w in report.warnings:
                print(w, file=sys.stderr)
            print(report.to_json() if args.format == "json" else report.to_text(), end="")
            return report.status
        return CLEAN
    except CannotStart as e:
        print(f"error: {e}", file=sys.stderr)
        return CANNOT_START
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return CLEAN


if __name__ == "__main__":
    sys.exit(main())
