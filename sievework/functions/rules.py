"""Rules as rows, and literals that any match of a regular expression must contain."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from re import _constants as kinds
from re import _parser as parser

from . import catalogue

#: What rule ids begin with.
ID_PREFIX = "SW"


@dataclass(frozen=True)
class Rule:
    order: int
    severity: str
    category: str
    message: str
    regex: str
    rule_id: str = ""

    @property
    def pattern(self) -> str:
        """The expression for the JVM: a dot matches all but a newline."""
        return "(?d)" + self.regex


def table(text: str, start: int = 0) -> list[Rule]:
    """Rules of a catalogue table, numbered in order."""
    rows = [line.split(" | ", 3) for line in text.strip("\n").split("\n")]
    return [Rule(start + k, severity, category, message, regex) for k, (severity, category, message, regex) in enumerate(rows)]


def flagged(rules: list[Rule], flags: str) -> list[Rule]:
    """The rules with inline flags, i, s or m, set for all of the expression."""
    return [replace(r, regex=f"(?{flags}){r.regex}") for r in rules]


#: Languages with their extensions and rules.
LANGUAGES: dict[str, tuple[tuple[str, ...], list[Rule]]] = {
    "python": ((".py",), table(catalogue.PYTHON)),
    "javascript": ((".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"), table(catalogue.JAVASCRIPT)),
    "shell": ((".sh", ".bash", ".zsh"), table(catalogue.SHELL)),
    "go": ((".go",), table(catalogue.GO)),
    "rust": ((".rs",), table(catalogue.RUST)),
    "java": ((".java", ".kt"), table(catalogue.JAVA)),
    "ruby": ((".rb",), table(catalogue.RUBY)),
    "php": ((".php",), table(catalogue.PHP)),
    "swift": ((".swift",), table(catalogue.SWIFT)),
    "c": ((".c", ".cpp", ".h", ".hpp"), table(catalogue.C_AND_CPP)),
    "lua": ((".lua",), table(catalogue.LUA)),
    "perl": ((".pl",), table(catalogue.PERL)),
    "csharp": ((".cs",), table(catalogue.CSHARP)),
}
SECRETS = [Rule(k, "CRITICAL", "SECRET", f"{label} detected", regex) for k, (label, regex) in enumerate(line.split(" | ", 1) for line in catalogue.SECRETS.strip("\n").split("\n"))]
KUBERNETES = table(catalogue.KUBERNETES)
TOOL_INJECTION = table(catalogue.TOOL_INJECTION)
AI_CONFIG = table(catalogue.AI_CONFIG)
INSTRUCTIONS = table(catalogue.TOOL_INJECTION + catalogue.AI_CONFIG.lstrip("\n"))
PROMPT_STRINGS = flagged(table(catalogue.PROMPT_STRINGS), "i")
DOCKERFILE = flagged(table(catalogue.DOCKERFILE), "i")
COMPOSE = flagged(table(catalogue.COMPOSE), "i")
MAKEFILE = flagged(table(catalogue.MAKEFILE), "i")
#: Rules on single lines of a workflow: run blocks and expressions over several lines have detectors of their own.
WORKFLOW = flagged([r for r in table(catalogue.WORKFLOW) if not r.message.startswith("GitHub Actions: attacker-controlled") and r"\n" not in r.regex], "i")
TEXT_INJECTION = [replace(r, message=f"In text file: {r.message}") for r in flagged([r for r in TOOL_INJECTION if r.severity == "CRITICAL"], "i")]
CAPABILITIES = [Rule(k, severity, "MCP", message, regex, f"{ID_PREFIX}-{tail}") for k, (severity, _, message, tail, regex) in enumerate(line.split(" | ", 4) for line in catalogue.CAPABILITIES.strip("\n").split("\n"))]
CAPABILITY_NAMES = [line.split(" | ")[1] for line in catalogue.CAPABILITIES.strip("\n").split("\n")]
SUSPICIOUS_URLS = catalogue.SUSPICIOUS_URLS.strip("\n").split("\n")
SUSPICIOUS_PACKAGES = {e: dict(line.split(" | ", 1) for line in t.strip("\n").split("\n")) for e, t in (("python", catalogue.SUSPICIOUS_PYTHON_PACKAGES), ("node", catalogue.SUSPICIOUS_NODE_PACKAGES))}


def _required(tree) -> list[str] | None:
    """Literals of which every match of a parsed sequence contains at least one; None if there are none."""
    best: list[str] | None = None
    run = ""

    def offer(found: list[str] | None) -> None:
        nonlocal best
        if found and all(found) and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    for op, value in tree:
        if op is kinds.LITERAL:
            run += chr(value)
            continue
        offer([run] if run else None)
        run = ""
        if op is kinds.SUBPATTERN:
            offer(_required(value[3]))
        elif op is kinds.BRANCH:
            parts = [_required(p) for p in value[1]]
            offer([x for p in parts for x in p] if all(parts) else None)
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            offer(_required(value[2]))
    offer([run] if run else None)
    return best


def anchors(regex: str) -> tuple[list[str] | None, bool]:
    """Literals of which any match contains one, and whether they hold for lower-cased text only."""
    tree = parser.parse(regex)
    ignore = bool(tree.state.flags & re.IGNORECASE)
    found = _required(tree)
    return ([x.lower() for x in found] if found and ignore else found), ignore


def matches(rule: Rule, text: str) -> bool:
    return re.search(rule.regex, text) is not None
