"""Scan a folder from the command line: `python -m sievework TARGET`."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework", description="Scan a source tree and grade what is found.")
    p.add_argument("target", help="folder to scan")
    p.add_argument("--json", action="store_true", help="the report as JSON")
    p.add_argument("--sarif", action="store_true", help="the report as SARIF 2.1.0")
    p.add_argument("--quiet", action="store_true", help="grade and exit code only")
    p.add_argument("--output", default="", help="write the report to this file")
    p.add_argument("--skip-deps", action="store_true", help="no dependency checks")
    p.add_argument("--no-taint", action="store_true", help="no taint analysis")
    p.add_argument("--no-signatures", action="store_true", help="no malware signatures")
    p.add_argument("--max-files", type=int, default=50_000)
    p.add_argument("--exclude", default="", help="globs to leave out, joined by commas")
    p.add_argument("--trust", action="store_true", help="let the target's own configuration and inline comments count")
    p.add_argument("--disable-rules", default="", help="rule ids, joined by commas")
    p.add_argument("--baseline", default="", help="report only what this baseline does not know")
    p.add_argument("--save-baseline", default="", help="write the fingerprints of the findings")
    p.add_argument("--policy", default="", help="such as critical=0,high<=5; decides the exit code")
    p.add_argument("--diff", default="", help="only files changed since this commit")
    p.add_argument("--verbose", action="store_true", help="keep findings of severity INFO")
    return p


def _list(joined: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in joined.split(",") if x.strip())


def main(argv: list[str] | None = None, spark=None) -> int:
    """The exit code: 0, 1 where the grade is D or F or the policy is not met, 2 where the target cannot be scanned."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import report, score, verify
    from .plans import target
    from .plans.scan import Config, scan
    from .sources.tree import from_tree

    args = parser().parse_args(argv)
    root = os.path.abspath(args.target)
    if not os.path.isdir(root):
        print(f"{args.target}: no such folder", file=sys.stderr)
        return 2
    changed = None
    if args.diff:
        got = subprocess.run(["git", "diff", "--name-only", args.diff, "HEAD"], capture_output=True, text=True, cwd=root)
        if got.returncode:
            print(got.stderr.strip(), file=sys.stderr)
            return 2
        changed = got.stdout.split("\n")[:-1]
    spark = spark or SparkSession.builder.getOrCreate()
    files = from_tree(spark, root, os.path.basename(root))
    config = Config(exclude=_list(args.exclude), max_files=args.max_files, trusted=args.trust, verbose=args.verbose, taint=not args.no_taint, signatures=not args.no_signatures, dependencies=not args.skip_deps, disabled=_list(args.disable_rules))
    wishes = target.read_wishes(root) if args.trust else target.Wishes()
    paths = None if changed is None else spark.createDataFrame([(os.path.basename(root), x) for x in changed], "repo_id string, path string")
    known = None
    if args.baseline:
        with open(args.baseline, encoding="utf-8") as f:
            known = spark.createDataFrame([(x,) for x in json.load(f)["fingerprints"]], "fingerprint string")
    result = scan(files, target.granted(config, wishes), paths, baseline=known, by_detector=True)
    findings = result.findings.persist()
    gaps = result.gaps.unionByName(target.left_out(files, wishes))
    graded = result.reports.first()
    if graded is None:
        print("nothing to scan", file=sys.stderr)
        return 2
    if args.save_baseline:
        prints = sorted({r.fingerprint for r in findings.filter("verified").select(verify.fingerprint().alias("fingerprint")).collect()})
        with open(args.save_baseline, "w", encoding="utf-8") as f:
            json.dump({"fingerprints": prints}, f)
    told = [r.text for r in target.warnings(gaps).orderBy("text").collect()] + list(wishes.warnings) + [f"Not checked: {x}" for x in target.disabled_checks(config)]
    if args.sarif:
        notes = spark.createDataFrame([(graded.repo_id, x) for x in told], "repo_id string, text string")
        one = report.sarif(findings, notes).first()
        out = one.sarif if one else json.dumps({"version": "2.1.0", "runs": []})
    elif args.json:
        body = json.loads(report.json_reports(findings, result.reports).first().report)
        body |= {"warnings": told, "coverage_gaps": [r.asDict() for r in gaps.orderBy("path", "reason").collect()], "disabled_checks": target.disabled_checks(config)}
        out = json.dumps(body, indent=2)
    elif args.quiet:
        out = f"GRADE: {graded.grade} (score: {graded.score})"
    else:
        out = "\n".join([report.summary(result.reports, findings), *told])
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(out + "\n")
    else:
        print(out)
    code = int(graded.grade in ("D", "F"))
    if args.policy:
        counts = score.policy_counts(findings)
        met = counts.select(score.policy(args.policy).alias("met")).first()
        # Without findings all counts are 0.
        none = spark.range(1).select(*[F.lit(0).alias(s.lower()) for s in score.SEVERITIES[:4]])
        code = int(not (met or none.select(score.policy(args.policy).alias("met")).first()).met)
    findings.unpersist()
    result.files.unpersist()
    return code


if __name__ == "__main__":
    sys.exit(main())
