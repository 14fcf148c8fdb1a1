"""The whole scan: files to findings, verified findings and reports, for any number of repositories at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.cwe import with_weakness
from ..functions.paths import categorised, readable
from ..functions.rules import Rule
from ..operators import configs, detect, score, verify
from ..operators.python_code import python_code
from ..sources.stored import written


@dataclass(frozen=True)
class Config:
    """Options of a scan; a target's own wishes come in through `suppressions`, within the limits that verification sets."""

    exclude: tuple[str, ...] = ()
    max_files: int | None = None
    trusted: bool = True
    verbose: bool = False
    taint: bool = True
    signatures: bool = True
    dependencies: bool = True
    disabled: tuple[str, ...] = ()
    suppressions: tuple[dict, ...] = ()
    custom: tuple[tuple[str, str, str, str, tuple[str, ...]], ...] = ()  # regex, category, severity, message, extensions
    weights: dict[str, int] = field(default_factory=lambda: dict(score.WEIGHTS))
    detectors: tuple[str, ...] = tuple(detect.ALL)


@dataclass(frozen=True)
class Scan:
    """Lazy results: files with their categories, all findings, a report for each repository, and what was not looked at."""

    files: DataFrame
    findings: DataFrame
    reports: DataFrame
    gaps: DataFrame


def wanted(files: DataFrame, config: Config, changed: DataFrame | None = None) -> DataFrame:
    """The files that are not excluded, and among the changed paths if those are given."""
    path = F.col("path")
    for g in config.exclude:
        files = files.filter(~path.rlike(text.glob_regex(g)))
    if changed is not None:
        files = files.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return files


def over_limit(files: DataFrame, limit: int) -> DataFrame:
    """repo_id and file_seq of the files from the limit on."""
    from pyspark.sql import Window

    # Repositories beyond the limit are rare; only those are numbered.
    many = files.groupBy(F.col("repo_id").alias("__r")).agg(F.count("*").alias("__n")).filter(F.col("__n") >= limit).select("__r")
    numbered = files.join(many, F.col("repo_id") == F.col("__r"), "left_semi").select("repo_id", "file_seq", F.row_number().over(Window.partitionBy("repo_id").orderBy("file_seq")).alias("nth"))
    return numbered.filter(F.col("nth") >= limit).select("repo_id", "file_seq")


def selected(files: DataFrame, config: Config, changed: DataFrame | None = None) -> DataFrame:
    """The files to look at: the wanted ones, and fewer than the limit if there is one."""
    files = wanted(files, config, changed)
    if config.max_files is None:
        return files
    return files.join(over_limit(files, config.max_files), ["repo_id", "file_seq"], "left_anti")


def gaps(files: DataFrame, kept: DataFrame, config: Config, changed: DataFrame | None = None) -> DataFrame:
    """What the scan did not look at in the kept files, and how many files the limit left out."""
    out = score.coverage_gaps(kept)
    if config.max_files is None:
        return out
    left = over_limit(wanted(files, config, changed), config.max_files).groupBy("repo_id").agg(F.count("*").alias("n"))
    return out.unionByName(left.select("repo_id", F.lit("").alias("path"), F.lit("file_limit_reached").alias("reason"), "n"))


def raw_parts(files: DataFrame, config: Config = Config(), commits: DataFrame | None = None, advisories: DataFrame | None = None) -> dict[str, Callable[[], DataFrame]]:
    """What makes the findings of each detector over categorised files; text detectors do not see the content of files over the size limit."""
    custom = [(Rule(1000 + k, severity, category, message, regex), tuple(ext)) for k, (regex, category, severity, message, ext) in enumerate(config.custom)]
    whole, files = files, readable(files)
    more = {"code": (config.trusted, custom), "prompts": (config.trusted,), "evasion": (config.trusted,)}
    parts = {name: partial(detect.ALL[name], whole if name == "signatures" else files, *more.get(name, ())) for name in config.detectors if config.signatures or name != "signatures"}
    parts["python"] = partial(python_code, files, config.trusted, config.taint)
    parts["mcp_config"] = partial(configs.mcp_config, whole)
    if config.dependencies:
        parts["dependencies"] = partial(configs.dependencies, whole, advisories)
    parts["licences"] = partial(configs.licences, whole)
    if commits is not None:
        parts["history"] = partial(detect.history, commits)
    return parts


def raw_findings(files: DataFrame, config: Config = Config(), commits: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors, as one lazy table."""
    return with_weakness(reduce(DataFrame.unionByName, [make() for make in raw_parts(files, config, commits, advisories).values()]))


def scan(files: DataFrame, config: Config = Config(), changed: DataFrame | None = None, commits: DataFrame | None = None, advisories: DataFrame | None = None, baseline: DataFrame | None = None, by_detector: bool = False) -> Scan:
    """Scan files (repo_id, file_seq, path, content, size); nothing runs until a result is read.

    With `by_detector` each detector is planned and written by itself at once, which is much sooner done than one plan of all.

    `files.unpersist()` of the result frees what the scan kept."""
    # All detectors read the categorised files, so these are kept; what does not fit in memory goes to disk.
    kept = categorised(selected(files, config, changed)).persist(StorageLevel.MEMORY_AND_DISK)
    raw = with_weakness(written(raw_parts(kept, config, commits, advisories), files.sparkSession)) if by_detector else raw_findings(kept, config, commits, advisories)
    findings = verify.verified(raw, list(config.suppressions), config.verbose)
    findings = verify.without_rules(findings, list(config.disabled))
    if baseline is not None:
        findings = verify.beyond(findings, baseline)
    totals = score.structure(kept)
    return Scan(kept, findings, score.reports(findings, totals, config.weights), gaps(files, kept, config, changed))
