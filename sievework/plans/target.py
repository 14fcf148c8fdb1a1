"""What a trusted target wishes for its own scan: a project file and an ignore file, within limits.

A target may leave files out, which is told, may raise the weights of serious findings but not lower them, and its
suppressions reach only what verification lets it (neither serious findings nor secrets)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import score
from .scan import Config

PROJECT_FILE, IGNORE_FILE = ".sievework.json", ".sievework-ignore"


@dataclass(frozen=True)
class Wishes:
    """What was read from a target: globs to leave out, the rest of its project file, and what could not be read."""

    exclude: tuple[str, ...] = ()
    project: dict | None = None
    warnings: tuple[str, ...] = ()


def read_wishes(root: str) -> Wishes:
    """The wishes of the target below root; only for trusted targets."""
    exclude, project, warnings = [], {}, []
    path = os.path.join(root, PROJECT_FILE)
    if os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                project = json.load(f)
            if not isinstance(project, dict):
                raise ValueError("not an object")
            exclude += [g for g in project.get("exclude", []) if isinstance(g, str)]
        except (OSError, ValueError) as e:
            project = {}
            warnings.append(f"Could not parse {PROJECT_FILE}: {e}")
    path = os.path.join(root, IGNORE_FILE)
    if os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            exclude += [x for line in f if (x := line.strip()) and not x.startswith("#")]
    return Wishes(tuple(dict.fromkeys(exclude)), project, tuple(warnings))


def granted(config: Config, wishes: Wishes) -> Config:
    """The options of a scan with a trusted target's wishes, as far as they are granted."""
    project = wishes.project or {}
    weights = dict(config.weights)
    for severity, w in project.get("severity_weights", {}).items():
        if severity in score.WEIGHTS and isinstance(w, (int, float)):
            weights[severity] = max(score.WEIGHTS[severity], w) if severity in ("CRITICAL", "HIGH") else w
    custom = tuple((c["pattern"], c.get("category", "CUSTOM"), c.get("severity", "MEDIUM"), c.get("message", "Custom pattern match"), tuple(c.get("languages", ()))) for c in project.get("custom_patterns", []) if "pattern" in c)
    return replace(config, exclude=(*config.exclude, *wishes.exclude), weights=weights, custom=(*config.custom, *custom), suppressions=(*config.suppressions, *project.get("suppressions", ())))


def left_out(files: DataFrame, wishes: Wishes) -> DataFrame:
    """repo_id, path, reason, n: a gap for each file that the target's own globs leave out."""
    hit = F.lit(False)
    for g in wishes.exclude:
        hit = hit | F.col("path").rlike(text.glob_regex(g))
    return files.filter(hit).select("repo_id", "path", F.lit("excluded_by_target_config").alias("reason"), F.lit(1).cast("long").alias("n"))


def disabled_checks(config: Config) -> list[str]:
    """The checks that whoever runs the scan turned off, to be said in its report."""
    off = {"dependency and advisory audit": not config.dependencies, "taint analysis": not config.taint, "signatures": not config.signatures}
    return [name for name, is_off in off.items() if is_off]


def warnings(gaps: DataFrame) -> DataFrame:
    """repo_id and text: the gaps in words, for reports; they change no grade."""
    reason = F.col("reason")
    kind = F.when(reason.contains("lines_exceed"), "lines").otherwise(reason)
    counted = gaps.groupBy("repo_id", kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(reason == "excluded_by_target_config", F.col("path")))), 1, 30), ", ").alias("names"))
    k, files, n = F.col("kind"), F.col("files").cast("string"), F.col("n").cast("string")
    told = F.when(k == "file_exceeds_500KB", F.concat(F.lit("Coverage: "), files, F.lit(" file(s) over 500KB were not scanned. Oversized content can hide payloads (see coverage_gaps).")))
    told = told.when(k == "lines", F.concat(F.lit("Coverage: "), n, F.lit(" line(s) over 2000 chars skipped across "), files, F.lit(" file(s). Minified content can hide payloads (see coverage_gaps).")))
    told = told.when(k == "excluded_by_target_config", F.concat(files, F.lit(" file(s) excluded from scan by target config: "), F.col("names"), F.lit(". Target-supplied excludes cannot silently drop files.")))
    return counted.select("repo_id", told.otherwise(F.concat(F.lit("Coverage: "), n, F.lit(" file(s) beyond the file limit were not scanned."))).alias("text"))
