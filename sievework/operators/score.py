"""Scores, grades and summaries of repositories, from the counts of their verified findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
# Weights, grades and what they say.
WEIGHTS = {"CRITICAL": 15, "HIGH": 7, "MEDIUM": 3, "LOW": 1, "INFO": 0}
BANDS = ((80, "A"), (65, "B"), (50, "C"), (30, "D"), (0, "F"))
#: Words of messages that speak of intent; three serious findings with any of them make a repository malicious.
INTENT = (
    "Prompt injection", "Data exfiltration", "credential theft", "API redirect instruction", "API base URL override", "API base URL set to non-official", "traffic hijacking", "Hidden instruction", "behavior override",
    "information suppression", "Schema poisoning", "Suspicious package", "Typosquat", "String concat assembles dangerous function", "Invisible Unicode char", "curl piped to shell", "wget piped to shell",
    "Suspicious URL: data exfiltration or tunneling",
)
VERDICTS = {"A": "INSTALL", "B": "INSTALL", "C": "REVIEW BEFORE INSTALLING", "D": "DO NOT INSTALL — VULNERABLE", "F": "DO NOT INSTALL"}


def structure(files: DataFrame) -> DataFrame:
    """A row for each repository: files, lines of source, sizes, languages, entry points and flags."""
    c = F.when(F.col("is_small"), F.col("content"))
    lines = text.newlines(c) + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)
    pairs = [F.lit(x) for kv in paths.LANGUAGE_NAMES.items() for x in kv]
    language = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("ext")), F.col("ext"))
    of = files.filter("is_source").groupBy("repo_id", language.alias("language")).agg(F.count("*").alias("n")).groupBy(F.col("repo_id").alias("__r")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    some = {"has_ai_config": "is_ai_config", "has_dockerfile": "is_dockerfile", "has_compose": "is_compose", "has_ci": "is_ci", "has_mcp_config": "is_mcp_config", "has_skill_md": "is_skill"}
    out = files.groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"), F.count_if("is_source").alias("source_files"), F.count_if("is_config").alias("config_files"), F.count_if("is_binary").alias("binary_count"),
        F.coalesce(F.sum(F.when(F.col("is_source"), lines)), F.lit(0)).cast("long").alias("total_lines"), F.array_sort(F.collect_list(F.when(F.col("is_entry_point"), F.col("path")))).alias("entry_points"), *[F.bool_or(v).alias(k) for k, v in some.items()],
    )
    return out.join(of, F.col("repo_id") == F.col("__r"), "left").drop("__r")


def coverage_gaps(files: DataFrame) -> DataFrame:
    """What the scan did not look at: files over the size limit, and long lines of source."""
    from ..functions.paths import readable

    files = readable(files)
    big = files.filter("oversize").select("repo_id", "path", F.lit("file_exceeds_500KB").alias("reason"), F.col("size").alias("n"))
    long = files.filter(F.col("is_source") & F.col("content").isNotNull()).withColumn("n", F.size(F.filter(F.split("content", "\n"), lambda x: F.length(x) > text.LONG_LINE)).cast("long")).filter("n > 0")
    return big.unionByName(long.select("repo_id", "path", F.concat(F.col("n").cast("string"), F.lit("_lines_exceed_2000_chars")).alias("reason"), "n")).dropDuplicates(["repo_id", "path", "reason"])


def score(critical: Column, high: Column, counts: dict[tuple[str, bool], Column], lines: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    """The score from counts by severity and whether it was lowered; critical and high are those not lowered.

    Each finding takes its share of what is left, so the order of findings does not matter."""
    density = F.when(lines > 50000, F.greatest(F.lit(0.4), 1 - (lines - 50000) / 500000.0)).when((lines > 0) & (lines < 1000), F.least(F.lit(1.5), 1 + (1000 - lines) / 2000.0)).otherwise(F.lit(1.0))
    left = F.lit(100.0)
    for (severity, lowered), n in counts.items():
        w = weights.get(severity, 0)
        if lowered:
            w = 0 if severity == "LOW" else max(1, w // 2) if severity == "MEDIUM" else w
        if w:
            left = left * F.pow(1 - w * density / 100.0, n.cast("double"))
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(left, 9)))).cast("int")
    scale = F.when(lines > 50000, F.least(F.lit(3), F.greatest(F.lit(1), F.floor(lines / 50000)))).otherwise(F.lit(1))
    most = F.when(critical >= 10 * scale, 10).when(critical >= 5 * scale, 20).when(critical >= 3 * scale, 35).when(critical >= 2 * scale, 45).when(critical >= scale, 49).otherwise(100)
    s = F.least(s, most, F.when(high >= 15 * scale, 25).when(high >= 10 * scale, 35).when(high >= 5 * scale, 50).otherwise(100))
    per = critical / F.when(lines > 0, lines) * 10000.0
    floor = F.when(critical == 0, F.when(high <= 3, 65).when(high <= 10, 50).otherwise(40)).when((critical <= 10 * scale) & (lines > 0), F.when(per < 0.5, 50).when(per < 1.0, 40).otherwise(0)).otherwise(0)
    return F.least(F.greatest(s, floor), F.when(critical >= 1, 64).otherwise(100)).cast("int")


def grade(s: Column, bands=BANDS) -> Column:
    out = F.lit("F")
    for least, letter in reversed(bands):
        out = F.when(s >= least, letter).otherwise(out)
    return out


def reports(findings: DataFrame, totals: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """A row for each repository of `totals` (repo_id, total_lines): counts, score, grade, verdict and recommendation."""
    ok = F.col("verified")
    lowered = F.col("original_severity") != ""
    aggs = [F.count_if(ok & (F.col("severity") == s) & (lowered == low)).alias(f"{s}_{int(low)}") for s in SEVERITIES for low in (False, True)]
    serious = ok & F.col("severity").isin("CRITICAL", "HIGH") & ~lowered
    speaks = F.lit(False)
    for w in INTENT:
        speaks = speaks | F.lower("message").contains(w.lower())
    counts = findings.groupBy(F.col("repo_id").alias("__r")).agg(*aggs, F.count_if(ok).alias("verified_count"), F.count_if(~ok & (F.col("suppression_source") != "")).alias("dismissed_count"), (F.count_if(serious & speaks) >= 3).alias("malicious_intent"))
    rows = totals.select("repo_id", "total_lines").join(counts, F.col("repo_id") == F.col("__r"), "left").drop("__r").na.fill(0)
    n = {(s, low): F.col(f"{s}_{int(low)}") for s in SEVERITIES for low in (False, True)}
    rows = rows.withColumn("score", score(n["CRITICAL", False], n["HIGH", False], n, F.col("total_lines"), weights)).withColumn("grade", grade(F.col("score")))
    rows = rows.withColumns({s.lower(): n[s, False] + n[s, True] for s in SEVERITIES})
    c, h = F.col("critical").cast("string"), F.col("high").cast("string")
    both = (F.col("critical") + F.col("high")).cast("string")
    g = F.col("grade")
    say = F.when(g == "A", F.concat(F.lit("Clean. Safe to install."), F.when(F.col("high") > 0, F.concat(F.lit(" Review "), h, F.lit(" HIGH finding(s) for awareness."))).otherwise("")))
    say = say.when(g == "B", F.concat(F.lit("Low risk. "), both, F.lit(" finding(s) worth reviewing before installing."))).when(g == "C", F.concat(F.lit("Review required. "), c, F.lit(" CRITICAL and "), h, F.lit(" HIGH finding(s). Check before installing.")))
    say = say.when(g == "D", F.concat(F.lit("Significant risks. "), c, F.lit(" CRITICAL and "), h, F.lit(" HIGH finding(s). Do NOT install without review."))).otherwise(F.concat(F.lit("FAIL. "), c, F.lit(" CRITICAL and "), h, F.lit(" HIGH finding(s). Do NOT install.")))
    names = [s.lower() for s in SEVERITIES]
    verdict = F.lit(None).cast("string")
    for letter, what in VERDICTS.items():
        verdict = F.when(g == letter, what).otherwise(verdict)
    return rows.withColumns({"recommendation": say, "verdict": verdict}).select("repo_id", "total_lines", *names, "verified_count", "dismissed_count", F.coalesce("malicious_intent", F.lit(False)).alias("malicious_intent"), "score", "grade", "verdict", "recommendation")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.filter("verified").groupBy("repo_id", "category", "severity").agg(F.count("*").alias("n"))


def drivers(findings: DataFrame) -> DataFrame:
    """What drove the grade: serious findings by category, the largest first, with two of their messages."""
    head = F.substring(text.strip(F.element_at(F.split("message", "—"), 1)), 1, 50)
    rows = findings.filter(F.col("verified") & F.col("severity").isin("CRITICAL", "HIGH"))
    place = F.struct("detector", "file_seq", "a", "b")
    # Of each category the first two heads, from the first place of each distinct one.
    heads = rows.groupBy("repo_id", "category", head.alias("head")).agg(F.min(place).alias("place"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    heads = heads.withColumn("at", F.row_number().over(Window.partitionBy("repo_id", "category").orderBy("place")))
    shown = F.array_compact(F.array(*[F.max(F.when(F.col("at") == k, F.col("head"))) for k in (1, 2)]))
    out = heads.groupBy("repo_id", "category").agg(F.sum("critical").alias("critical"), F.sum("high").alias("high"), shown.alias("heads"))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("repo_id").orderBy((F.col("critical") + F.col("high")).desc(), "category")))


def policy(expression: str) -> Column:
    """Whether the counts critical, high, medium, low (not lowered) satisfy `severity op n`, joined by commas; clauses of another form do not count."""
    out = F.lit(True)
    for clause in expression.split(","):
        m = re.match(r"(critical|high|medium|low)\s*(<=?|>=?|==?)\s*(\d+)", clause.strip(), re.IGNORECASE)
        if m:
            n, limit = F.col(m.group(1).lower()), int(m.group(3))
            out = out & {"<": n < limit, "<=": n <= limit, ">": n > limit, ">=": n >= limit, "=": n == limit, "==": n == limit}[m.group(2)]
    return out


def policy_counts(findings: DataFrame) -> DataFrame:
    kept = F.col("verified") & (F.col("original_severity") == "")
    return findings.groupBy("repo_id").agg(*[F.count_if(kept & (F.col("severity") == s)).alias(s.lower()) for s in SEVERITIES[:4]])
