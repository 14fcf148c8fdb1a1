"""Checks of server configurations in JSON, of manifests and lockfiles, and of licences."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import rules, text
from .detect import findings, rule_hits

# Commands and names that matter in a server's configuration.
COMMANDS = "rm curl wget bash sh powershell cmd".split()
SECRET_NAMES = "key secret token password auth".split()
SHORTEST_TEXT = 30


def servers(files: DataFrame) -> DataFrame:
    """One row for each server of each server configuration: name and config, a VARIANT."""
    rows = files.filter("is_mcp_config").withColumn("v", F.try_parse_json("content")).filter("v IS NOT NULL")
    rows = rows.withColumn("all", F.expr("coalesce(try_variant_get(v, '$.mcpServers', 'variant'), try_variant_get(v, '$.servers', 'variant'))")).filter("schema_of_variant(all) LIKE 'OBJECT%'")
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("all").outer()).select("pos", F.col("key").alias("server"), F.col("value").alias("config"))).filter("schema_of_variant(config) LIKE 'OBJECT%'")


def mcp_config(files: DataFrame) -> DataFrame:
    """Dangerous commands, written-out secrets, and poisoned texts at any depth of a server's configuration."""
    rows = servers(files).withColumns({"command": F.expr("coalesce(try_variant_get(config, '$.command', 'string'), '')"), "n": F.col("pos")})
    ends = F.lit(False)
    for c in COMMANDS:
        ends = ends | F.col("command").endswith(c)
    arguments = F.expr("array_join(slice(coalesce(try_variant_get(config, '$.args', 'array<string>'), array()), 1, 3), ' ')")
    commands = findings(rows.filter(ends), "mcp_config", F.col("n"), F.lit(0), F.lit("CRITICAL"), F.lit("MCP"), F.lit(0), F.concat(F.lit("MCP server '"), F.col("server"), F.lit("' uses dangerous command: "), F.col("command")), F.concat_ws(" ", "command", arguments))
    env = rows.withColumn("env", F.expr("coalesce(try_variant_get(config, '$.env', 'map<string,string>'), map())")).select("*", F.posexplode("env").alias("at", "key", "value"))
    named = F.lit(False)
    for s in SECRET_NAMES:
        named = named | F.lower("key").contains(s)
    env = env.filter(named & (F.length("value") > 10) & ~F.col("value").startswith("${"))
    secrets = findings(env, "mcp_config", F.col("n"), F.lit(1) + F.col("at"), F.lit("CRITICAL"), F.lit("SECRET"), F.lit(0), F.concat(F.lit("Hardcoded secret in MCP config env: "), F.col("key")), F.concat(F.col("key"), F.lit("=[REDACTED]")))
    return commands.unionByName(secrets).unionByName(poisoning(rows))


@F.udf(ArrayType(StructType().add("at", "string").add("text", "string")), useArrow=False)
def _texts(config: str, server: str) -> list[tuple[str, str]]:
    """All texts of a configuration that are long enough, at any depth, each with its path."""
    out, left = [], [(server, json.loads(config))]
    while left:
        at, v = left.pop()
        if isinstance(v, str):
            if len(v) > SHORTEST_TEXT:
                out.append((at, v))
        elif isinstance(v, dict):
            left.extend((f"{at}.{k}", w) for k, w in v.items())
        elif isinstance(v, list):
            left.extend((f"{at}[{k}]", w) for k, w in enumerate(v))
    return out


def poisoning(rows: DataFrame) -> DataFrame:
    """Instructions in the texts of a server: reported if it has two, or one in a description.

    One pass over each configuration outside the JVM, where a walk to any depth is a loop."""
    leaves = rows.select("repo_id", "file_seq", "path", "content", "n", "server", F.explode(_texts(F.to_json("config"), "server")).alias("leaf")).select("*", "leaf.*").drop("leaf")
    leaves = leaves.withColumn("hit", F.explode(rule_hits(F.col("text"), rules.INSTRUCTIONS)))
    from pyspark.sql import Window

    server = Window.partitionBy("repo_id", "file_seq", "n")
    leaves = leaves.withColumns({"hits": F.count("*").over(server), "told": F.max(F.lower("at").contains("description").cast("int")).over(server)}).filter("hits >= 2 OR told = 1")
    found_at = F.expr("locate(substring(text, 1, 60), content)")
    line = F.when(found_at > 0, F.lit(1) + text.newlines(F.expr("substring(content, 1, locate(substring(text, 1, 60), content) - 1)"))).otherwise(0)
    message = F.concat(F.lit("Schema poisoning in '"), F.col("server"), F.lit("' at "), F.col("at"), F.lit(": "), F.col("hit.message"))
    return findings(leaves, "mcp_config", F.col("n"), F.lit(1000) + F.col("hit.rule"), F.col("hit.severity"), F.lit("MCP"), line, message, F.substring("text", 1, 100))


# Packages imported under another name, and packages that are used without an import.
IMPORT_NAMES = {
    "pillow": "pil", "scikit-learn": "sklearn", "python-dateutil": "dateutil", "pyyaml": "yaml", "beautifulsoup4": "bs4", "opencv-python": "cv2", "opencv-python-headless": "cv2", "python-dotenv": "dotenv",
    "pymysql": "pymysql", "python-multipart": "multipart", "python-jose": "jose", "python-decouple": "decouple", "python-magic": "magic", "python-slugify": "slugify", "msgpack-python": "msgpack", "ruamel.yaml": "ruamel",
    "attrs": "attr", "cattrs": "cattr", "google-cloud-storage": "google", "google-cloud-bigquery": "google", "google-auth": "google", "google-api-python-client": "googleapiclient", "tensorflow-gpu": "tensorflow", "tensorflow-cpu": "tensorflow",
}
PYTHON_TOOLS = "setuptools wheel pip build twine pytest black flake8 mypy isort pylint pre-commit coverage tox sphinx nox ruff setuptools-scm flit flit-core hatch hatchling maturin cython poetry poetry-core pdm pdm-backend".split()
NODE_TOOLS = "typescript webpack vite rollup esbuild parcel eslint prettier jest mocha vitest tsx ts-node @types tailwindcss postcss autoprefixer nodemon husky lint-staged commitlint @commitlint semantic-release release-it turbo lerna nx".split()
LIFECYCLE = "preinstall postinstall preuninstall install prepare prepack".split()
RISKY_SCRIPTS = ("curl", "wget", "eval", "base64", "nc ", "/dev/tcp", "python", "node -e", "powershell", "cmd /c")
SHOWN_PHANTOMS = 10


def _root(files: DataFrame, name: str) -> DataFrame:
    return files.filter((F.col("path") == name) & F.col("content").isNotNull())


def declared_python(files: DataFrame) -> DataFrame:
    """repo_id, ecosystem, manifest, name, spec, pinned, optional from requirements and project files."""
    line = text.strip(F.col("line"))
    req = _root(files, "requirements.txt").select("repo_id", F.explode(F.split("content", "\n")).alias("line")).filter((line != "") & ~line.rlike("^[#-]"))
    req = req.select("repo_id", F.lit("python").alias("ecosystem"), F.lit("requirements.txt").alias("manifest"), text.strip(F.split(line, r"[>=<!\[~]")[0]).alias("name"), line.alias("spec"), line.rlike("[><=!~]=|[><]").alias("pinned"), F.lit(False).alias("optional"))

    def read(batches):
        import re
        import tomllib

        import pandas as pd

        for pdf in batches:
            rows = []
            for repo, content in zip(pdf.repo_id, pdf.content, strict=True):
                try:
                    data = tomllib.loads(content)
                except ValueError:
                    continue
                project = data.get("project", {})
                specs = [(d, False) for d in project.get("dependencies", [])]
                specs += [(d, True) for group in project.get("optional-dependencies", {}).values() if isinstance(group, list) for d in group]
                specs += [(p, False) for p in data.get("tool", {}).get("poetry", {}).get("dependencies", {}) if p.lower() != "python"]
                for spec, optional in specs:
                    name = re.split(r"[>=<!\[;\s~]", spec)[0].strip()
                    if name:
                        rows.append((repo, "python", "pyproject.toml", name, spec, bool(re.search(r"[><=!~]=|[><]", spec)), optional))
            yield pd.DataFrame(rows, columns=["repo_id", "ecosystem", "manifest", "name", "spec", "pinned", "optional"])

    toml = _root(files, "pyproject.toml").select("repo_id", "content").mapInPandas(read, req.schema)
    return req.unionByName(toml)


def _entries(v: str, path: str) -> str:
    return f"map_entries(coalesce(try_variant_get({v}, '{path}', 'map<string,string>'), map()))"


def declared_node(files: DataFrame) -> DataFrame:
    """The same columns from package.json; `optional` marks development dependencies."""
    rows = _root(files, "package.json").withColumn("v", F.try_parse_json("content")).filter("v IS NOT NULL")
    out = None
    for key, dev in (("$.dependencies", False), ("$.devDependencies", True)):
        x = rows.select("repo_id", F.explode(F.expr(_entries("v", key))).alias("e"))
        x = x.select("repo_id", F.lit("node").alias("ecosystem"), F.lit("package.json").alias("manifest"), F.col("e.key").alias("name"), F.col("e.value").alias("spec"), (~F.col("e.value").rlike(r"^[\^~]|^\*$|^latest$")).alias("pinned"), F.lit(dev).alias("optional"))
        out = x if out is None else out.unionByName(x)
    return out


def counted(files: DataFrame) -> DataFrame:
    """Dependencies of go.mod and Cargo.toml: repo_id, ecosystem, n."""
    fold = lambda opens, closes, counts: lambda s, line: F.struct(F.when(opens(line), True).when(closes(line), False).otherwise(s["on"]).alias("on"), (s["n"] + F.when(counts(s, line), 1).otherwise(0)).alias("n"))
    start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("n"))
    s = text.strip
    go = fold(lambda x: s(x).startswith("require ("), lambda x: s(x) == ")", lambda st, x: (st["on"] & (F.size(F.split(s(x), r"\s+")) >= 2) & ~s(x).startswith("//")) | s(x).rlike(r"^require\s+[^(]"))
    cargo = fold(lambda x: s(x).startswith("[dependencies") | s(x).startswith("[dev-dependencies"), lambda x: s(x).startswith("["), lambda st, x: st["on"] & x.contains("=") & ~s(x).startswith("["))
    out = None
    for name, eco, step in (("go.mod", "go", go), ("Cargo.toml", "cargo", cargo)):
        x = _root(files, name).select("repo_id", F.lit(eco).alias("ecosystem"), F.aggregate(F.split("content", "\n"), start, step, lambda st: st["n"]).cast("long").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


def imported(files: DataFrame) -> DataFrame:
    """repo_id, ecosystem and name of every package that source lines import."""
    rows = files.filter((F.col("ext") == ".py") & ~F.col("name").isin("setup.py", "conftest.py") & F.col("content").isNotNull()).select("repo_id", F.explode(F.split("content", "\n")).alias("line"))
    py = None
    for regex in (r"^\s*(?:import|from)\s+(\w+)", r"importlib\.import_module\s*\(\s*['\"](\w+)", r"__import__\s*\(\s*['\"](\w+)"):
        x = rows.select("repo_id", F.lit("python").alias("ecosystem"), F.lower(F.regexp_extract("line", regex, 1)).alias("name"))
        py = x if py is None else py.unionByName(x)
    rows = files.filter(F.col("ext").isin(*rules.LANGUAGES["javascript"][0]) & F.col("content").isNotNull()).select("repo_id", F.explode(F.split("content", "\n")).alias("line"))
    js = None
    for regex in (r"(?:require\s*\(\s*['\"]|from\s+['\"])(@?[a-z0-9][\w\-.]*(?:/[a-z0-9][\w\-.]*)?)", r"import\s*\(\s*['\"]([@\w\-./]+)"):
        x = rows.select("repo_id", F.lit("node").alias("ecosystem"), F.split(F.regexp_extract("line", regex, 1), "/")[0].alias("name"))
        js = x if js is None else js.unionByName(x)
    return py.unionByName(js).filter("name <> ''").distinct()


def phantoms(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Declared packages that nothing imports, numbered by name in each repository and ecosystem; `shown` marks those reported."""
    from pyspark.sql import Window

    eco, name = F.col("ecosystem"), F.lower("name")
    pairs = [x for kv in IMPORT_NAMES.items() for x in kv]
    python_name = F.coalesce(F.expr("try_element_at(map(" + ", ".join(f"'{x}'" for x in pairs) + "), lower(name))"), F.translate(name, "-.", "__"))
    base = F.split("name", "/")[0]
    d = declared.filter(~F.col("optional")).withColumns({"as_name": F.when(eco == "python", name).otherwise(F.col("name")), "as_import": F.when(eco == "python", python_name).otherwise(base)})
    d = d.filter(F.when(eco == "python", ~name.isin(PYTHON_TOOLS)).otherwise(~base.isin(NODE_TOOLS) & ~base.startswith("@types")))
    optional = declared.filter((F.col("optional")) & (eco == "python")).select("repo_id", "ecosystem", F.lower("name").alias("as_name")).distinct()
    d = d.join(optional, ["repo_id", "ecosystem", "as_name"], "left_anti")
    for key in ("as_import", "as_name"):
        d = d.join(used.select("repo_id", "ecosystem", F.col("name").alias(key)), ["repo_id", "ecosystem", key], "left_anti")
    d = d.groupBy("repo_id", "ecosystem", "as_name").agg(F.max("manifest").alias("manifest"))
    bad = F.lit(False)
    for e, some in rules.SUSPICIOUS_PACKAGES.items():
        known = [x.lower() for x in some]
        bad = bad | ((eco == e) & (F.lower(F.split("as_name", "/")[0]).isin(known) | F.lower("as_name").isin(known)))
    d = d.withColumn("suspicious", bad).withColumn("nth", F.row_number().over(Window.partitionBy("repo_id", "ecosystem", "suspicious").orderBy("as_name")))
    return d.withColumn("shown", F.col("suspicious") | (F.col("nth") <= SHOWN_PHANTOMS))


def locked(files: DataFrame) -> DataFrame:
    """repo_id, name and version of package-lock.json, in either of its layouts."""
    rows = _root(files, "package-lock.json").withColumn("v", F.try_parse_json("content")).filter("v IS NOT NULL")
    rows = rows.withColumn("all", F.expr("coalesce(try_variant_get(v, '$.packages', 'variant'), try_variant_get(v, '$.dependencies', 'variant'))")).filter("all IS NOT NULL")
    x = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("all").outer()).select("key", "value"))
    # A package's own entry is that below node_modules, else the one of its bare name; copies inside other packages are none.
    below = F.regexp_extract("key", r"^node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    bare = F.when(~F.col("key").startswith("node_modules/"), F.col("key"))
    x = x.select("repo_id", F.when(below != "", below).otherwise(bare).alias("name"), (below != "").alias("own"), F.expr("try_variant_get(value, '$.version', 'string')").alias("version"))
    return x.filter("name <> '' AND version IS NOT NULL").groupBy("repo_id", "name").agg(F.max_by("version", "own").alias("version"))


def drifts(spec: Column, version: Column) -> Column:
    """Whether a locked version lies outside what a caret or tilde allows."""
    want, got = F.split(F.regexp_replace(spec, r"^[\^~]+", ""), r"\."), F.split(version, r"\.")
    two = F.slice(want, 1, 2) != F.slice(got, 1, 2)
    caret = F.when(want[0] == "0", (F.size(want) >= 2) & (F.size(got) >= 2) & two).otherwise(want[0] != got[0])
    return F.when(spec.startswith("^"), caret).when(spec.startswith("~"), two).otherwise(F.lit(False))


def _repo_findings(rows: DataFrame, nth: Column, severity: Column, category: str, path: Column, message: Column, snippet: Column = None) -> DataFrame:
    rows = rows.withColumns({"file_seq": F.lit(-2).cast("long"), "path": path})
    return findings(rows, "dependencies", nth, F.lit(0), severity, F.lit(category), F.lit(0), message, F.lit("") if snippet is None else snippet)


def dependencies(files: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Suspicious and phantom packages, lockfile drift, install scripts, and packages with known advisories.

    advisories has ecosystem, package, version, id, summary and score."""
    declared = declared_python(files).unionByName(declared_node(files))
    reason = F.lit(None).cast("string")
    for e, some in rules.SUSPICIOUS_PACKAGES.items():
        for pkg, why in some.items():
            reason = F.when((F.col("ecosystem") == e) & (F.lower("name") == pkg.lower()), why).otherwise(reason)
    out = _repo_findings(declared.withColumn("why", reason).filter("why IS NOT NULL"), F.lit(0), F.lit("CRITICAL"), "DEPENDENCY", F.col("manifest"), F.concat(F.lit("Suspicious package: "), F.col("name"), F.lit(" — "), F.col("why")))
    lost = phantoms(declared, imported(files)).filter("shown")
    out = out.unionByName(_repo_findings(lost, F.lit(1000) + F.col("nth"), F.lit("MEDIUM"), "DEPENDENCY", F.col("manifest"), F.concat(F.lit("Phantom dependency: '"), F.col("as_name"), F.lit("' declared but never imported"))))
    scripts = _root(files, "package.json").withColumn("v", F.try_parse_json("content")).filter("v IS NOT NULL").select("repo_id", F.posexplode(F.expr(_entries("v", "$.scripts"))).alias("nth", "e")).filter(F.col("e.key").isin(LIFECYCLE))
    risky = F.lit(False)
    for r in RISKY_SCRIPTS:
        risky = risky | F.col("e.value").contains(r)
    message = F.when(risky, F.concat(F.lit("Dangerous "), F.col("e.key"), F.lit(" script — may execute malicious code on install"))).otherwise(F.concat(F.lit("Package has "), F.col("e.key"), F.lit(" script — runs automatically on npm install")))
    out = out.unionByName(_repo_findings(scripts, F.lit(2000) + F.col("nth"), F.when(risky, "CRITICAL").otherwise("MEDIUM"), "EXECUTION", F.lit("package.json"), message, F.col("e.value")))
    drift = declared.filter("ecosystem = 'node' AND NOT optional").join(locked(files), ["repo_id", "name"]).filter(drifts(F.col("spec"), F.col("version")))
    out = out.unionByName(_repo_findings(drift, F.lit(3000), F.lit("HIGH"), "DEPENDENCY", F.lit("package-lock.json"), F.concat(F.lit("Lockfile drift: "), F.col("name"), F.lit(" declared "), F.col("spec"), F.lit(" but locked at "), F.col("version"))))
    if advisories is not None:
        versions = locked(files).withColumn("ecosystem", F.lit("node")).unionByName(declared.filter("spec LIKE '%==%'").select("repo_id", "name", F.trim(F.split("spec", "==")[1]).alias("version"), "ecosystem"))
        hit = versions.join(advisories, (versions.ecosystem == advisories.ecosystem) & (F.lower(versions.name) == F.lower(advisories.package)) & (versions.version == advisories.version)).select("repo_id", "package", versions.version, "id", "summary", "score")
        out = out.unionByName(_repo_findings(hit, F.lit(4000), F.when(F.col("score") >= 9, "CRITICAL").otherwise("HIGH"), "DEPENDENCY", F.lit(""), F.concat(F.lit("CVE in "), F.col("package"), F.lit(" "), F.col("version"), F.lit(": "), F.col("id"), F.lit(" — "), F.substring("summary", 1, 100))))
    return out


def licences(files: DataFrame) -> DataFrame:
    """Repositories without a licence, and copyleft licences."""
    top = ~F.col("path").contains("/")
    is_licence = top & F.upper("path").rlike("^(?:LICENSE|LICENCE)|^COPYING$")
    field = F.when(F.col("path") == "package.json", F.expr("coalesce(try_variant_get(try_parse_json(content), '$.license', 'string'), '') <> ''")).when(F.col("path") == "pyproject.toml", F.lower("content").contains("license")).otherwise(F.lit(False))
    repos = files.groupBy("repo_id").agg(F.max(is_licence.cast("int")).alias("has"), F.max(F.coalesce(field, F.lit(False)).cast("int")).alias("field")).filter("has = 0 AND field = 0")
    none = _repo_findings(repos, F.lit(5000), F.lit("MEDIUM"), "LICENSE", F.lit(""), F.lit("No license file found — usage rights unclear"))
    head = F.upper(F.substring("content", 1, 2000))
    rows = files.filter(is_licence & F.col("content").isNotNull()).withColumn("kind", F.when(head.contains("AGPL") | head.contains("AFFERO"), "AGPL").when(head.contains("GPL") & ~head.contains("LGPL"), "GPL")).filter("kind IS NOT NULL")
    message = F.when(F.col("kind") == "AGPL", "AGPL license — requires source disclosure for network use").otherwise("GPL license — copyleft, check compatibility")
    return none.unionByName(_repo_findings(rows, F.lit(5001), F.when(F.col("kind") == "AGPL", "MEDIUM").otherwise("LOW"), "LICENSE", F.col("path"), message))
