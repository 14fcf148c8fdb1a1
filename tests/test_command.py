"""The command line, and what a trusted target may wish for."""

import json

from sievework.__main__ import main
from sievework.operators import score
from sievework.plans.scan import Config
from sievework.plans.target import granted, read_wishes


def test_wishes_are_granted_within_limits(tmp_path):
    (tmp_path / ".sievework.json").write_text(json.dumps({"exclude": ["gen/*"], "severity_weights": {"HIGH": 0, "CRITICAL": 40, "LOW": 0}, "custom_patterns": [{"pattern": "x", "languages": [".py"]}], "suppressions": [{"rule": "r", "files": ["a"]}]}))
    (tmp_path / ".sievework-ignore").write_text("# note\n\nvendor/*\n")
    wishes = read_wishes(str(tmp_path))
    got = granted(Config(exclude=("own",)), wishes)
    assert got.exclude == ("own", "gen/*", "vendor/*") and got.suppressions == ({"rule": "r", "files": ["a"]},)
    assert (got.weights["HIGH"], got.weights["CRITICAL"], got.weights["LOW"]) == (score.WEIGHTS["HIGH"], 40, 0)
    assert got.custom == (("x", "CUSTOM", "MEDIUM", "Custom pattern match", (".py",)),)
    (tmp_path / ".sievework.json").write_text("{broken")
    assert read_wishes(str(tmp_path)).warnings and read_wishes(str(tmp_path)).exclude == ("vendor/*",)


def test_command(spark, tmp_path, capsys):
    root = tmp_path / "repo"
    (root / "gen").mkdir(parents=True)
    (root / "a.py").write_text("import os\nos.system(x)\n" + "y" * 3000)
    (root / "gen" / "b.py").write_text("eval(x)")
    (root / ".sievework-ignore").write_text("gen/*")
    out = tmp_path / "out.json"
    assert main([str(root), "--trust", "--json", "--skip-deps", "--no-taint", "--output", str(out), "--policy", "critical=0,high<=0"], spark) == 1
    body = json.loads(out.read_text())
    assert {f["file"] for f in body["findings"]} >= {"a.py"} and not any(f["file"].startswith("gen") for f in body["findings"])
    assert {(g["path"], g["reason"]) for g in body["coverage_gaps"]} == {("a.py", "1_lines_exceed_2000_chars"), ("gen/b.py", "excluded_by_target_config")}
    assert len(body["disabled_checks"]) == 2 and any("excluded from scan by target config: gen/b.py" in w for w in body["warnings"])
    assert main([str(tmp_path / "none")], spark) == 2
