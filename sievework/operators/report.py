"""Reports: one JSON document, or one SARIF document, for each repository, and a text summary."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .verify import fingerprint

ENGINE = "sievework"
# Levels and schema of the SARIF format.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


#: The place of a finding in its repository.
PLACE = ("detector", "file_seq", "a", "b")
#: Items in a piece of a report, as a power of two.
PIECE = 10


def _pieces(rows: DataFrame, part: int, place: tuple[str, ...], then: tuple[str, ...], body: Column) -> DataFrame:
    """repo_id, part, piece and text: some items that follow each other, with a comma before each; pieces are numbered in the order of place and then.

    Ranges of items are sorted and become text side by side, whatever repositories they belong to, so that no task holds a repository's items as objects."""
    ranged = rows.filter("repo_id IS NOT NULL").repartitionByRange("repo_id", *place).sortWithinPartitions("repo_id", *place, *then)
    # These numbers follow the order of ranges and of the rows in each.
    items = ranged.select("repo_id", F.concat(F.lit(","), body).alias("text"), F.monotonically_increasing_id().alias("at")).withColumn("piece", F.shiftright("at", PIECE))
    # Texts compress so well that partitions joined by their bytes on disk would hold too much; a given number stays.
    dealt = items.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo_id", "piece")
    joined = F.concat_ws("", F.array_sort(F.collect_list(F.struct("at", "text")))["text"])
    return dealt.groupBy("repo_id", "piece").agg(joined.alias("text")).select("repo_id", F.lit(part).alias("part"), "piece", "text")


def _whole(rows: DataFrame, part: int, body: Column) -> DataFrame:
    """A part that is one piece."""
    return rows.select("repo_id", F.lit(part).alias("part"), F.lit(0).cast("long").alias("piece"), F.concat(F.lit(","), body).alias("text"))


def _part(k: int) -> list[Column]:
    """What a part of the repository's document is put together from: its first piece without the comma, and the other pieces as they are."""
    pieces = F.array_sort(F.collect_list(F.when(F.col("part") == k, F.struct("piece", "text"))))["text"]
    return [F.substring(F.get(pieces, F.lit(0)), F.lit(2), F.length(F.get(pieces, F.lit(0)))), F.slice(pieces, F.lit(2), F.size(pieces))]


def _documents(name: str, parts: list[DataFrame], *body: Column) -> DataFrame:
    """A document for each repository. It is put together once, and nothing follows, as each step would copy it whole."""
    return reduce(DataFrame.unionByName, parts).groupBy("repo_id").agg(F.concat_ws("", *body).alias(name))


def json_reports(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """repo_id and report: the summary with kept and suppressed findings, as JSON."""
    kept = ("severity", "category", "file", "line", "message", "snippet", "rule_id", "cwe", "original_severity")
    gone = (*kept, "suppression_source", "suppression_reason")
    summary_ = F.to_json(F.struct(*reports.columns))
    told = findings.join(reports.select("repo_id"), "repo_id", "left_semi")
    parts = [
        _whole(reports, 0, F.substring(summary_, F.lit(1), F.length(summary_) - 1)),
        _pieces(told.filter("verified"), 1, PLACE, kept, F.to_json(F.struct(*kept))),
        _pieces(told.filter("NOT verified"), 2, PLACE, gone, F.to_json(F.struct(*gone))),
    ]
    return _documents("report", parts, *_part(0), F.lit(',"findings":['), *_part(1), F.lit('],"suppressed_findings":['), *_part(2), F.lit("]}"))


def sarif(findings: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """repo_id and sarif: version 2.1.0, rules in the order in which they first occur; warnings has repo_id and text."""
    level = F.lit("warning")
    for s, l in LEVELS.items():
        level = F.when(F.col("severity") == s, l).otherwise(level)
    rows = findings.filter("verified").withColumns({"level": level, "print": fingerprint(), "name": F.substring(text.strip(F.element_at(F.split("message", "—"), 1)), 1, 60)})
    # A rule is told by its first finding; rules are numbered in the order of these, before findings are gathered.
    place_ = F.struct("detector", "file_seq", "a", "b")
    first = rows.groupBy("repo_id", "rule_id").agg(F.min(F.struct(place_.alias("place"), "name", "message", "level", "severity", "cwe")).alias("first"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("repo_id").orderBy("first.place", "rule_id")) - 1)
    told_of = F.when(F.col("first.cwe") != "", F.struct(F.array("first.cwe").alias("tags"), F.when(F.col("first.severity") == "CRITICAL", "9.0").when(F.col("first.severity") == "HIGH", "7.0").otherwise("4.0").alias("security-severity")))
    help_ = F.when(F.col("first.cwe") != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.split("first.cwe", "-")[1], F.lit(".html")))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("first.name").alias("name"), F.struct(F.col("first.message").alias("text")).alias("shortDescription"), F.struct(F.col("first.level").alias("level")).alias("defaultConfiguration"), told_of.alias("properties"), help_.alias("helpUri"))
    numbered = first.select(F.col("repo_id").alias("__o"), F.col("rule_id").alias("__i"), F.col("nth").cast("long").alias("nth"), rule.alias("rule"))
    rows = rows.join(numbered.select("__o", "__i", "nth"), (F.col("repo_id") == F.col("__o")) & (F.col("rule_id") == F.col("__i")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("nth").alias("ruleIndex"), "level", F.struct(F.concat("message", F.when(F.col("snippet") != "", F.concat(F.lit(" | "), F.col("snippet"))).otherwise("")).alias("text")).alias("message"),
        F.struct(F.col("print").alias(f"{ENGINE}/v1")).alias("fingerprints"), F.filter(F.array(place), lambda _: F.col("file") != "").alias("locations"),
    )
    parts = [
        _pieces(numbered.withColumnRenamed("__o", "repo_id"), 0, ("nth",), (), F.to_json("rule")),
        _pieces(rows, 1, PLACE, ("rule_id", "nth", "level", "message", "snippet", "file", "line", "print"), F.to_json(result)),
    ]
    if warnings is not None:
        told = warnings.join(numbered.select(F.col("__o").alias("repo_id")), "repo_id", "left_semi").groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("warning").alias("level"), F.struct("text").alias("message")))).alias("told"))
        notes = F.to_json("told")
        parts.append(_whole(told, 2, F.substring(notes, F.lit(2), F.length(notes) - 2)))
    head = f'{{"$schema":{json.dumps(SCHEMA)},"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":{json.dumps(ENGINE)},"rules":['
    return _documents("sarif", parts, F.lit(head), *_part(0), F.lit(']}},"results":['), *_part(1), F.lit('],"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":['), *_part(2), F.lit("]}]}]}"))


def manifest(findings: DataFrame) -> DataFrame:
    """Capabilities that tool files grant, with their files, the most severe first."""
    from ..functions.rules import CAPABILITIES, CAPABILITY_NAMES

    name = F.lit(None).cast("string")
    for r, n in zip(CAPABILITIES, CAPABILITY_NAMES, strict=True):
        name = F.when(F.col("rule_id") == r.rule_id, n).otherwise(name)
    rows = findings.withColumn("capability", name).filter("capability IS NOT NULL")
    return rows.groupBy("repo_id", "capability", "severity").agg(F.array_sort(F.collect_set("file")).alias("files")).orderBy("repo_id", F.expr("array_position(array('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'), severity)"), "capability")


def summary(report: DataFrame, findings: DataFrame, shown: int = 40) -> str:
    """A text for one repository: its grade and its gravest findings. Collects those lines only."""
    r = report.first()
    if r is None:
        return "nothing scanned"
    rank = F.expr("array_position(array('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'), severity)")
    rows = findings.filter((F.col("repo_id") == r.repo_id) & F.col("verified")).orderBy(rank, "detector", "file_seq", "a", "b").limit(shown).collect()
    head = [f"{r.repo_id}: grade {r.grade}, score {r.score}", r.recommendation]
    return "\n".join(head + [f"{x.severity:8} {x.file}:{x.line} {x.message}" for x in rows])
