"""One run over source trees: findings, what was left out, and how it is told."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillion.functions.markers import CODES, near_miss, suppression
from quillion.operators.findings import findings
from quillion.plans.scratch import Scratch
from quillion.sources import config as configuration
from quillion.sources import extract, walk

SCHEMA_VERSION = "2"
CLEAN, FOUND, CANNOT_START = 0, 1, 2
RULES = {
    "TPX001": "A comment run longer than its word limit",
    "TPX002": "A docstring longer than its word limit",
    "TPX003": "One explanation repeated across comments and docstrings, reported once with every place it appears",
}


@dataclass
class Report:
    findings: list[dict]
    skipped: list[tuple[str, str]]
    excluded: list[str]
    warnings: list[str]

    @property
    def complete(self) -> bool:
        return not self.skipped

    @property
    def status(self) -> int:
        return CLEAN if self.complete and not self.findings else FOUND

    def to_json(self) -> str:
        doc = {
            "schema_version": SCHEMA_VERSION,
            "complete": self.complete,
            "skipped": [{"path": p, "reason": r} for p, r in sorted(self.skipped)],
            "excluded": sorted(self.excluded),
            "findings": self.findings,
        }
        return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"

    def to_text(self) -> str:
        out = [f["message"] for f in self.findings]
        k = len(self.skipped)
        rest = f"; check incomplete: {k} file{'' if k == 1 else 's'} skipped." if k else "."
        if self.findings:
            counts = [(c, sum(f["code"] == c for f in self.findings)) for c in CODES]
            out.append(f"Found {len(self.findings)} findings ({', '.join(f'{c}: {n}' for c, n in counts if n)})" + rest)
        elif k:
            out.append("No findings" + rest)
        else:
            out.append("All checks passed!")
        return "\n".join(out) + "\n"


def _finding(row) -> dict:
    d = row.asDict(recursive=True)
    out = {k: d[k] for k in ("code", "path", "line", "end_line", "prose_kind", "message")}
    names = ("locations", "weakest") if d["locations"] is not None else ("words", "max_volume")
    return out | {k: d[k] for k in names}


def _warnings(blocks, config) -> list[str]:
    lines = F.explode(F.array(F.struct((F.col("line_start") - 1).alias("n"), F.col("line_above").alias("line")), F.struct(F.col("line_start").alias("n"), F.col("first_line").alias("line"))))
    odd = blocks.select("path", lines.alias("e")).where("e.n > 0").where(near_miss(F.col("e.line")))
    out = [f"warning: {r.path}:{r.n}: this is not an opt-out marker and silences nothing; the form is `# !TPX001` — `# !TPX001,TPX002` for several, `# !TPX*` for all" for r in odd.select("path", "e.n").collect()]
    comment = F.col("kind") == "comment"
    code = F.when(comment, "TPX001").otherwise("TPX002")
    long = F.col("size_words") > F.when(comment, config.comment_max).otherwise(config.docstring_max)
    matters = (long & ~code.isin(*config.ignore) if config.ignore else long) | ((F.col("size_lines") >= 2) & (F.col("size_words") >= 8))
    unknown = blocks.where(matters).select("path", "line_start", F.explode(suppression(F.col("line_above"))["unknown"]).alias("code"))
    out += [f"warning: {r.path}:{max(0, r.line_start - 1)}: `{r.code}` in an opt-out marker is not a rule code; it silences nothing" for r in unknown.collect()]
    return sorted(out)


def check(spark: SparkSession, paths: list[str], table_name: str = configuration.TABLE) -> Report:
    """Everything that the rules say about the Python files of `paths`. `CannotStart` if a path or the configuration is wrong."""
    loaded = configuration.load_all([Path(p) for p in paths], table_name)
    source = loaded.source or "the configuration"
    files, excluded, unwalkable = walk.merge(spark, [walk.walk(p, loaded) for p in paths])
    blocks, skipped = extract.read_sources(walk.with_content(files))
    blocks = Scratch(spark, "blocks").keep(blocks.select(*[c for c in blocks.columns if c != "narrative"], "narrative"))
    warnings = []
    if set(loaded.config.ignore) == set(CODES):
        warnings.append(f"warning: every rule ({', '.join(CODES)}) is disabled by `ignore` in {source}; this run cannot report a finding")
    if not files.take(1) and not unwalkable:
        warnings.append(f"warning: no Python files under {paths[0] if len(paths) == 1 else 'the selected paths'}")
        if excluded:
            warnings.append(f"warning: `exclude` in {source} removed {len(excluded)} path(s) that could have been measured; nothing outside the excluded set was left to check")
    warnings += _warnings(blocks, loaded.config)
    left_out = sorted({*unwalkable, *((r.path, r.reason) for r in skipped.collect())})
    found = [_finding(r) for r in findings(blocks, loaded.config).collect()]
    if left_out:
        warnings.append(f"warning: {len(left_out)} file(s) skipped:\n" + "\n".join(f"  {p}: {r}" for p, r in left_out))
        if "TPX003" not in loaded.config.ignore:
            warnings.append("warning: TPX003 was computed over an incomplete set of files; a missing file makes a different cluster graph, not the same clusters minus a file")
    return Report(found, left_out, excluded, warnings)
