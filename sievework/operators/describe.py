"""What a repository says it is, and what kind of tool that makes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

READMES = ("README.md", "readme.md", "README.rst", "README")
# Words of descriptions and keywords that tell the kind.
SECURITY = "security scanner vulnerability exploit pentest audit scan detection malware forensic osint reconnaissance injection fuzzer fuzzing secret".split()
WEB = ("web framework", "web application", "http server", "api framework", "rest api", "graphql")
LIBRARY = ("library", "utility", "helper", "toolkit", "sdk", "client")
TERMINAL = ("cli", "command-line", "command line", "terminal")
BUILD = ("build", "bundler", "compiler", "transpiler", "minifier")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _root(name: str, value: Column) -> Column:
    """An aggregate: the value for the file of this name at the top of the repository."""
    return F.max(F.when(F.col("path") == name, value))


def descriptions(files: DataFrame) -> DataFrame:
    """repo_id and description: of package.json, else of pyproject.toml, else a README's first line that says something."""
    c = F.col("content")
    package = F.expr("try_variant_get(try_parse_json(content), '$.description', 'string')")
    lines = F.split(c, "\n")
    project = F.filter(F.transform(F.filter(lines, lambda x: strip(x).startswith("description") & x.contains("=")), lambda x: F.regexp_replace(strip(F.substring_index(x, "=", -1)), "^['\"]+|['\"]+$", "")), lambda x: x != "")[0]
    said = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), "^#+", ""))), lambda x: (F.length(x) >= 15) & ~x.rlike(r"^(?:!\[|\[!|<|>|---|\*\*\*|```)") & ~x.rlike(r"^\[.*\]\(.*\)$"))[0]
    parts = [_root("package.json", F.nullif(package, F.lit(""))), _root("pyproject.toml", project), *[_root(r, said) for r in READMES]]
    return files.filter(~F.col("path").contains("/")).groupBy("repo_id").agg(F.substring(F.coalesce(*parts, F.lit("")), 1, 200).alias("description"))


def tool_types(files: DataFrame, structure: DataFrame) -> DataFrame:
    """repo_id, description and tool_type, by an ordered list of signs; structure is that of the score module."""
    c, path = F.col("content"), F.col("path")
    json = "try_variant_get(try_parse_json(content), '{}', '{}')"
    keywords = F.transform(F.expr(json.format("$.keywords", "array<string>")), F.lower)
    runs = F.expr(json.format("$.bin", "variant")).isNotNull()
    runs = F.when(path == "package.json", runs).when(path == "pyproject.toml", c.contains("[project.scripts]") | c.contains("[tool.poetry.scripts]")).when(path.isin("setup.py", "setup.cfg"), c.contains("console_scripts")).when(path == "Cargo.toml", c.contains("[[bin]]"))
    top = files.filter(~path.contains("/")).groupBy(F.col("repo_id").alias("__t")).agg(F.max(F.coalesce(runs, F.lit(False))).alias("runs"), F.max(F.when(path == "package.json", keywords)).alias("keywords"), F.max(F.when(path == "manifest.json", c.contains("manifest_version"))).alias("extension"))
    rows = structure.join(descriptions(files).withColumnRenamed("repo_id", "__d"), F.col("repo_id") == F.col("__d"), "left").join(top, F.col("repo_id") == F.col("__t"), "left").withColumn("description", F.coalesce("description", F.lit("")))
    d = F.lower("description")
    web = _any(d, WEB)
    security = _any(d, SECURITY) | F.coalesce(F.arrays_overlap("keywords", F.array(*map(F.lit, SECURITY))), F.lit(False))
    kind = F.when(F.col("has_mcp_config"), "mcp-server").when(security, "security-tool")
    served = (F.col("has_dockerfile") | web) & (web | _any(d, ("web", "server")))
    kind = kind.when(served & _any(d, ("framework", "library")), "framework").when(served, "web-app").when(d.contains("framework"), "framework").when(_any(d, LIBRARY), "library")
    kind = kind.when(F.coalesce("runs", F.lit(False)) | _any(d, TERMINAL), "cli-tool").when(F.coalesce("extension", F.lit(False)), "browser-extension").when(_any(d, BUILD), "build-tool").when(F.col("has_skill_md"), "cli-tool").when(F.col("source_files") > 0, "library").otherwise("unknown")
    return rows.select("repo_id", "description", kind.alias("tool_type"))
