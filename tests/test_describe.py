from sievework.functions.paths import categorised
from sievework.operators.describe import tool_types
from sievework.operators.score import coverage_gaps, structure


def test_tool_types(spark):
    repos = {
        "a": {"mcp.json": "{}"},
        "b": {"pyproject.toml": '[project]\ndescription = "A tidy thing"\n[project.scripts]\nx = "y"'},
        "c": {"README.md": "# C\n[![badge](x)](y)\nA vulnerability scanner for all\n"},
        "d": {"package.json": '{"description": "REST API for cats"}', "Dockerfile": "FROM x"},
        "e": {"x.py": "a = 1"},
        "f": {"notes.bin": "x"},
        "g": {"package.json": '{"keywords": ["OSINT"]}', "README.md": "text that is long enough"},
    }
    rows = [(r, k, p, t, len(t)) for r, texts in repos.items() for k, (p, t) in enumerate(texts.items())]
    files = categorised(spark.createDataFrame(rows, "repo_id string, file_seq long, path string, content string, size long"))
    got = {r.repo_id: (r.tool_type, r.description) for r in tool_types(files, structure(files)).collect()}
    assert got == {
        "a": ("mcp-server", ""), "b": ("cli-tool", "A tidy thing"), "c": ("security-tool", "A vulnerability scanner for all"), "d": ("web-app", "REST API for cats"),
        "e": ("library", ""), "f": ("unknown", ""), "g": ("security-tool", "text that is long enough"),
    }


def test_coverage_gaps(spark):
    rows = [("r", 1, "big.py", "x", 600_000), ("r", 2, "long.py", "y" * 3000 + "\nz", 3002), ("r", 3, "pic.png", "x", 900_000)]
    files = categorised(spark.createDataFrame(rows, "repo_id string, file_seq long, path string, content string, size long"))
    assert {(r.path, r.reason) for r in coverage_gaps(files).collect()} == {("big.py", "file_exceeds_500KB"), ("long.py", "1_lines_exceed_2000_chars")}
