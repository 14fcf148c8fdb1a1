"""Reports put together from pieces, against plain Python."""

import json
import random

import pytest

from sievework.operators import report

KEPT = ("severity", "category", "file", "line", "message", "snippet", "rule_id", "cwe", "original_severity")
GONE = (*KEPT, "suppression_source", "suppression_reason")
TYPES = "repo_id string, detector int, file_seq long, a int, b int, severity string, category string, file string, line int, message string, snippet string, rule_id string, cwe string, original_severity string, suppression_source string, suppression_reason string, verified boolean"


@pytest.fixture
def made(spark, monkeypatch):
    """Findings of four repositories, with quotes, nulls and places that only the items' fields tell apart."""
    monkeypatch.setattr(report, "PIECE", 1)
    rng = random.Random(1)
    rows = []
    for k in range(300):
        repo, ok, rule = rng.choice(["a", "a", "a", "b", "none", None]), rng.random() < 0.7, rng.randrange(9)
        rows.append((repo, rng.randrange(3), rng.randrange(4), rng.randrange(2), 0, rng.choice(["CRITICAL", "LOW"]), "X", rng.choice(['f"\\é—𝒳\n', "", "g/h.py"]), rng.choice([0, 3, None]), f"m{rule} — why", rng.choice(["", ",],{"]), f"r{rule}", rng.choice(["", "CWE-78"]), "", "" if ok else "cap", "" if ok else "], why", ok))
    reports = spark.createDataFrame([("a", 7, "F"), ("b", 5, "A"), ("c", None, "A")], "repo_id string, score int, grade string")
    return rows, spark.createDataFrame(rows, TYPES).repartition(5), reports


def told(rows, repo, verified, columns):
    names = [x.split()[0] for x in TYPES.split(", ")]
    of = [dict(zip(names, r, strict=True)) for r in rows if r[0] == repo and r[-1] == verified]
    of.sort(key=lambda x: [(x[c] is not None, x[c]) if not isinstance(x[c], str) else x[c].encode() for c in ("detector", "file_seq", "a", "b", *columns)])
    return [{c: x[c] for c in columns if x[c] is not None} for x in of]


def test_json_reports(made):
    rows, findings, reports = made
    got = {r.repo_id: json.loads(r.report) for r in report.json_reports(findings, reports).collect()}
    summary = {"a": {"score": 7, "grade": "F"}, "b": {"score": 5, "grade": "A"}, "c": {"grade": "A"}}
    assert got == {k: {"repo_id": k, **v, "findings": told(rows, k, True, KEPT), "suppressed_findings": told(rows, k, False, GONE)} for k, v in summary.items()}
    assert len(got["a"]["findings"]) > 50 and not got["c"]["findings"]


def test_sarif(spark, made):
    rows, findings, _ = made
    notes = spark.createDataFrame([("b", "y]"), ("b", "x"), ("c", "z")], "repo_id string, text string")
    runs = {r.repo_id: json.loads(r.sarif)["runs"][0] for r in report.sarif(findings, notes).collect()}
    assert set(runs) == {"a", "b", "none"}
    for k, run in runs.items():
        rules = [x["id"] for x in run["tool"]["driver"]["rules"]]
        items = told(rows, k, True, ("rule_id", *KEPT))
        assert len(set(rules)) == len(rules) and set(rules) == {x["rule_id"] for x in items}
        assert [rules[x["ruleIndex"]] for x in run["results"]] == [x["ruleId"] for x in run["results"]] == [x["rule_id"] for x in items]
        assert run["invocations"] == [{"executionSuccessful": True, "toolExecutionNotifications": [{"level": "warning", "message": {"text": t}} for t in ("x", "y]")] if k == "b" else []}]


def test_documents_are_gathered_as_pieces_and_not_copied(made):
    """The aggregation that makes a document comes last, and gathers texts of several items in ranges that are sorted side by side."""
    _, findings, reports = made
    for df in (report.json_reports(findings, reports), report.sarif(findings)):
        plan = df._jdf.queryExecution()
        assert plan.optimizedPlan().nodeName() == "Aggregate"
        assert "rangepartitioning(repo_id" in plan.executedPlan().toString()
