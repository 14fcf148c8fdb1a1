import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import paths, rules, text
from sievework.operators import score, verify

EVERY = [r for _, some in rules.LANGUAGES.values() for r in some] + rules.SECRETS + rules.KUBERNETES + rules.INSTRUCTIONS + rules.PROMPT_STRINGS + rules.DOCKERFILE + rules.COMPOSE + rules.MAKEFILE + rules.WORKFLOW + rules.CAPABILITIES


def test_every_rule_has_anchors_and_compiles():
    for r in EVERY:
        re.compile(r.regex)
        assert rules.anchors(r.regex)[0], r.regex


@pytest.mark.parametrize("line", ["x = eval(data)", "pickle.loads(b)", "os.system('x')", "cursor.execute(f'SELECT {x}')", "password = 'hunter2hunter2'", "https://u:p@host/x", "Ignore ALL previous instructions", "privileged:  true", "curl http://x | bash"])
def test_anchors_are_necessary(line):
    for r in EVERY:
        if re.search(r.regex, line):
            found, lower = rules.anchors(r.regex)
            assert any(a in (line.lower() if lower else line) for a in found), (r.regex, line)


def test_finditer_equals_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n xé1=") for _ in range(rng.randint(0, 120))) for _ in range(200)] + ["ab\n1= x\nba" * 20_000, "", "\n\nab"]
    for regex in (r"a+b?", r"\d=", r"x\n", r"(?:ab|ba)+"):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        got = {r.k: [(m.line, m.text) for m in r.m] for r in df.select("k", text.finditer(F.col("t"), regex).alias("m")).collect()}
        for k, t in enumerate(texts):
            assert got[k] == [(t[: m.start()].count("\n") + 1, m.group(0)) for m in re.finditer(regex, t)], (regex, t)


def test_comment_mask(spark):
    cases = [
        (".py", ["# a", "x", '"""doc', "eval(", 'end"""', "y", '"""one"""', "z"], "10111010"),
        (".js", ["/* a", "b", "c */", "d", "// e", "/* f */", "g"], "1110110"),
        (".rb", ["=begin", "x", "=end", "y", "# z"], "11101"),
        (".sh", ["#!x", "y", "/* not */"], "100"),
        (".go", ["x /* no", "y"], "00"),
        (".c", (["/*"] + ["a"] * 700 + ["*/"] + ["b"] * 600) * 30, ("1" * 702 + "0" * 600) * 30),
        (".rs", ["/*"] + ["a"] * (text.PIECE_LINES - 1) + ["*/", "b"], "1" * (text.PIECE_LINES + 1) + "0"),
        (".java", ["// a"] * text.PIECE_LINES + ["/* x"] * 2, "1" * (text.PIECE_LINES + 2)),
    ]
    df = spark.createDataFrame([(e, ls) for e, ls, _ in cases], "ext string, ls array<string>")
    got = {r.ext: "".join(str(int(x)) for x in r.m) for r in df.select("ext", text.comment_mask(F.col("ls"), F.col("ext"), False).alias("m")).collect()}
    assert got == {e: m for e, _, m in cases}


def test_globs():
    import fnmatch

    for g in ("*.py", "a/*", "x?z", "[ab]*", "[!a]b", "a.b+c", "**/t"):
        for p in ("a.py", "a/b.py", "xyz", "bcd", "cb", "a.b+c", "axb+c", "q/r/t"):
            assert bool(re.search(text.glob_regex(g), p)) == fnmatch.fnmatchcase(p, g), (g, p)


def test_placeholders(spark):
    values = {"your_api_key": True, "example": True, "Zx81cvbQw93e": False, "AKexampleQWERTYUIOP": False, "<token>": True, "xxxxxxxx": True, "": False, "admin:admin": True, "dummy1": True}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.p for r in df.select("v", text.is_placeholder(F.col("v")).alias("p")).collect()} == values


def test_extensions_and_categories(spark):
    files = [("r", k, p, "x", 1) for k, p in enumerate(["a/b.PY", ".env.local", "Dockerfile.dev", "node_modules/x.js", "a/docker-compose.yml", ".github/workflows/c.yml", "x.tar.gz", "setup.cfg", "noext"])]
    df = paths.categorised(spark.createDataFrame(files, "repo_id string, file_seq long, path string, content string, size long"))
    got = {r.path: r for r in df.collect()}
    assert "node_modules/x.js" not in got
    assert got["a/b.PY"].is_source and got["a/b.PY"].ext == ".py" and got[".env.local"].is_env and got["Dockerfile.dev"].is_dockerfile
    assert got["a/docker-compose.yml"].is_compose and got[".github/workflows/c.yml"].is_ci and got["x.tar.gz"].ext == ".gz" and got["setup.cfg"].is_setup and got["noext"].ext == ""


def one_score(spark, critical=0, high=0, high_low=0, lines=0):
    df = spark.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in (("c", critical), ("h", high), ("hl", high_low), ("n", lines))])
    counts = {("CRITICAL", False): F.col("c"), ("HIGH", False): F.col("h"), ("LOW", True): F.col("hl")}
    return df.select(score.score(F.col("c"), F.col("h"), counts, F.col("n")).alias("s")).first().s


def test_score_table(spark):
    assert one_score(spark) == 100
    for n, most in ((1, 49), (2, 45), (3, 35), (5, 20), (10, 10)):
        assert one_score(spark, critical=n) <= most
    assert one_score(spark, high=10) <= 50 and one_score(spark, high=200) >= 40
    assert one_score(spark, critical=1, lines=500_000) > 49 and one_score(spark, critical=1, lines=500) <= 49
    assert one_score(spark, high_low=5) > one_score(spark, high=5)


def test_policy(spark):
    df = spark.createDataFrame([(1, 2, 0, 0)], "critical int, high int, medium int, low int")
    for p, want in (("critical<=1", True), ("critical=0", False), ("high<=2", True), ("high<2", False), ("nonsense", True), ("critical<=1,high<2", False)):
        assert df.select(score.policy(p).alias("p")).first().p is want


def test_verification(spark):
    base = [
        ("r", 0, 1, 1, 0, "HIGH", "EXECUTION", "tests/a.py", 1, "os.system() — shell command execution", "os.system(x)"),
        ("r", 0, 2, 1, 0, "CRITICAL", "EXECUTION", "examples/b.py", 1, "m", "s"),
        ("r", 0, 3, 1, 0, "HIGH", "EXECUTION", "a.py", 1, "eval() — executes arbitrary code", "model.eval(x)"),
        ("r", 0, 4, 1, 0, "HIGH", "NETWORK", "n.py", 3, "Suspicious URL", "http://10.0.0.1/x"),
        ("r", 0, 5, 1, 0, "MEDIUM", "EXECUTION", "third_party/v.py", 1, "m2", "s"),
        ("r", 0, 6, 1, 0, "CRITICAL", "SECRET", "c.py", 1, "AWS detected", "[REDACTED: AK...1]"),
        ("r", 0, 7, 1, 0, "CRITICAL", "SECRET", "tests/t.py", 1, "AWS detected", "zzz"),
        ("r", 0, 8, 1, 0, "LOW", "FILESYSTEM", "q.py", 1, "File deletion", "os.remove(x)"),
    ]
    base += [("r", 0, 9, k, 0, "HIGH", "EXECUTION", "cap.py", k, "exec() — executes arbitrary code", "exec(x)") for k in range(1, 6)]
    df = spark.createDataFrame(base, "repo_id string, detector int, file_seq long, a int, b int, severity string, category string, file string, line int, message string, snippet string").withColumn("rule_id", text.rule_id(F.col("category"), F.col("message")))
    rule = df.filter("message = 'File deletion'").first().rule_id
    got = {(r.file, r.line): r for r in verify.verified(df, [{"rule": rule, "files": ["q*"], "reason": "known"}]).collect()}
    assert (got["tests/a.py", 1].severity, got["tests/a.py", 1].original_severity) == ("LOW", "HIGH")
    assert got["examples/b.py", 1].severity == "MEDIUM" and got["a.py", 1].suppression_source == "method_call"
    assert got["n.py", 3].suppression_source == "private_ip" and got["third_party/v.py", 1].severity == "LOW"
    assert got["c.py", 1].verified and got["tests/t.py", 1].suppression_source == "info_severity"
    assert got["q.py", 1].suppression_source == "config_suppress"
    assert [got["cap.py", k].verified for k in range(1, 6)] == [True, True, False, False, False]
    late = verify.verified(df, [{"rule": rule, "files": ["q*"], "expires": "2020-01-01"}])
    assert late.filter("file = 'q.py'").first().verified
