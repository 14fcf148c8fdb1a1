"""What a file is, by its path: extensions, categories and contexts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and extensions that define the categories.
SOURCE = ".py .js .ts .jsx .tsx .mjs .cjs .sh .bash .zsh .rb .go .rs .java .kt .swift .c .cpp .h .hpp .php .pl .lua .cs".split()
CONFIG = ".json .yaml .yml .toml .ini .cfg .conf .xml .plist".split()
AI_CONFIG = "claude.md .claude.md claude_md .cursorrules .cursorignore copilot-instructions.md .github/copilot-instructions.md .aider.conf.yml .continue/config.json .codeium/config.json rules.md .rules system-prompt.md system_prompt.txt".split()
BINARY = ".exe .dll .so .dylib .a .o .obj .wasm .pyc .pyo .class .bin .dat".split()
MEDIA = ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .tif .pdf .zip .tar .gz .bz2 .xz .7z .rar .mp3 .mp4 .mov .avi .mkv .wav .flac .ogg .webm .woff .woff2 .ttf .otf .eot .jar .war .whl .egg".split()
TRANSLATIONS = ".po .pot .mo".split()
SKIPPED_DIRS = "node_modules .git __pycache__ .venv venv env .tox .mypy_cache .pytest_cache dist build .next .nuxt coverage .coverage .eggs vendor target out bin .idea .vscode".split()
ENTRY_POINTS = "main.py server.py index.js index.ts app.py app.js app.ts cli.py cli.js run.py run.js main.js main.ts mod.rs main.go main.rs".split()
LANGUAGE_NAMES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React JSX", ".tsx": "React TSX", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".java": "Java", ".kt": "Kotlin", ".swift": "Swift", ".sh": "Shell", ".bash": "Bash", ".c": "C", ".cpp": "C++", ".php": "PHP", ".lua": "Lua", ".pl": "Perl", ".cs": "C#"}
TEST_DIRS = "test tests t spec specs fixture fixtures mock mocks __tests__ __test__ testdata test_data".split()
EXAMPLE_DIRS = "example examples sample samples demo demos tutorial tutorials cookbook cookbooks evaluation evaluations capabilities recipes notebooks snippets playground playgrounds sandbox sandboxes workshop workshops template templates scaffold scaffolds starter starters boilerplate boilerplates".split()
DOCS_DIRS = "docs doc guide guides how-to howto".split()
DOCS_FILES = "readme.md readme.rst readme readme.txt changelog.md changelog.rst changelog contributing.md contributing.rst contributing history.md history.rst changes.md changes.rst news.md news.rst".split()
DEVTOOL_DIRS = "scripts script tools build dev hack contrib".split()
INFRA_DIRS = ".devcontainer .github .circleci .gitlab".split()
REFERENCE_DIRS = "references reference".split()
RULE_DIRS = "rules detectors signatures patterns checks yara sigma indicators ruleset rulesets".split()
MAX_BYTES = 500_000
FILE_COLUMNS = ("repo_id", "file_seq", "path", "content", "size", "link_target")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix of the name in lower case; a leading dot alone begins none."""
    return F.lower(F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _within(path: Column, dirs: list[str]) -> Column:
    return F.arrays_overlap(directories(path), F.array(*map(F.lit, dirs)))


def _starts(c: Column, prefixes) -> Column:
    return c.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def categorised(files: DataFrame) -> DataFrame:
    """Files with name, ext and the category flags; skipped directories are left out at any depth.

    All keep their content; `readable` takes it from text detectors where a file is over the size limit. Columns that
    files do not have by their schema are left out, so that their names meet no detector's."""
    files = files.select(*[c for c in FILE_COLUMNS if c in files.columns])
    path, low = F.col("path"), F.lower(F.col("path"))
    files = files.filter(~_within(path, SKIPPED_DIRS)).withColumns({"name": F.lower(name(path)), "ext": extension(path)})
    n, e = F.col("name"), F.col("ext")
    files = files.withColumns(
        {
            "is_source": e.isin(SOURCE),
            "is_config": e.isin(CONFIG),
            "is_ai_config": n.isin(AI_CONFIG) | low.isin(AI_CONFIG),
            "is_dockerfile": (n == "dockerfile") | n.startswith("dockerfile."),
            "is_compose": n.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml") | n.startswith("docker-compose."),
            "is_ci": (path.startswith(".github") & path.contains("/") & e.isin(".yml", ".yaml")) | n.isin(".gitlab-ci.yml", "jenkinsfile", "bitbucket-pipelines.yml") | low.endswith(".circleci/config.yml"),
            "is_makefile": n.isin("makefile", "gnumakefile") | n.startswith("makefile."),
            "is_binary": e.isin(BINARY),
            "is_env": n.startswith(".env"),
            "is_mcp_config": n.isin("mcp.json", "claude_desktop_config.json"),
            "is_skill": n == "skill.md",
            "is_setup": n.isin("setup.py", "setup.cfg"),
            "is_entry_point": n.isin(ENTRY_POINTS),
        }
    )
    small = F.col("size") <= MAX_BYTES
    text = F.col("is_source") | F.col("is_config") | F.col("is_env") | e.isin(".md", ".txt", ".rst") | (~F.col("is_binary") & small)
    return files.withColumns({"is_text": text, "oversize": ~small & ~e.isin(BINARY + MEDIA), "is_small": small})


def readable(files: DataFrame) -> DataFrame:
    """The files as text detectors see them: without the content of those over the size limit."""
    return files.withColumn("content", F.when(F.col("is_small"), F.col("content")))


def contexts(file: Column) -> dict[str, Column]:
    """The contexts of a finding's file that change its severity."""
    f = F.lower(file)
    n = name(f)
    return {
        "test": _within(f, TEST_DIRS) | n.startswith("test_") | n.rlike(r"[._](?:test|spec)\.") | (n == "conftest.py"),
        "example": _within(f, EXAMPLE_DIRS) | F.exists(directories(f), lambda d: _starts(d, ("example", "sample", "demo", "tutorial"))),
        "docs": _within(f, DOCS_DIRS) | n.isin(DOCS_FILES),
        "template": f.contains(".example") | f.contains(".template") | f.contains(".sample") | f.contains(".dist"),
        "vendor": _starts(f, ("vendor/", "third_party/", "third-party/", "extern/", "external/")) | f.contains("/_vendor/") | f.contains("/vendor/") | f.contains("/extern/") | f.contains("/external/"),
        "devtool": _within(f, DEVTOOL_DIRS) | f.rlike("makefile|gruntfile|gulpfile|rakefile|playgrounds/|benchmarks/|bench/"),
        "infra": _within(f, INFRA_DIRS),
        "reference": _within(f, REFERENCE_DIRS),
        "rules": _within(f, RULE_DIRS) | n.isin("gitleaks.toml", ".gitleaks.toml") | n.rlike(r"\.(?:yar|yara|sigma)$"),
        "skill": f.endswith("skill.md"),
    }
