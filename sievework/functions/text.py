"""Column expressions over texts: matches with line numbers, comment masks, entropy, globs, rule ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ID_PREFIX, Rule, anchors

LONG_LINE = 2000
#: Lines whose comment mask is made as one string.
PIECE_LINES = 512
C_FAMILY = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".php")
HASH_FAMILY = (".py", ".rb", ".sh", ".bash", ".zsh", ".php")
INLINE_IGNORE = r"(?i)(?:#|//|--)\s*sievework:\s*ignore"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def guard(c: Column, rules: list[Rule], low: Column | None = None) -> Column:
    """Whether any of the rules can match: their required literals, or true where a rule has none; low is c in lower case, if at hand."""
    low = F.lower(c) if low is None else low
    exact, lower = [], []
    for r in rules:
        found, ignore = anchors(r.regex)
        if not found:
            return F.lit(True)
        (lower if ignore else exact).extend(found)
    parts = [c.contains(x) for x in dict.fromkeys(exact)] + [low.contains(x) for x in dict.fromkeys(lower)]
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def finditer(content: Column, regex: str) -> Column:
    """All matches in order: array of (line, text); the expression must not match the empty string.

    Of the text between matches only its line ends are kept, and an x for each match: the x's of a line are its matches."""
    between, hits = F.split(content, regex, -1), F.regexp_extract_all(content, F.lit(regex), 0)
    ends = lambda c: F.regexp_replace(c, r"[^\n]+", "")
    marks = F.array_join(F.zip_with(between, hits, lambda b, h: F.concat(ends(b), F.coalesce(F.concat(F.lit("x"), ends(h)), F.lit("")))), "")
    lines = F.flatten(F.transform(F.split(marks, "\n", -1), lambda l, i: F.array_repeat(i + 1, F.length(l))))
    return F.zip_with(lines, hits, lambda l, h: F.struct(l.alias("line"), h.alias("text")))


def first_match(content: Column, regex: str) -> Column:
    """(line, text) of the first match, or null."""
    head = F.split(content, regex, 2)
    found = F.regexp_extract(content, regex, 0)
    return F.when(content.rlike(regex), F.struct((F.lit(1) + newlines(head[0])).alias("line"), found.alias("text")))


def _is_prefix_comment(line: Column, ext: Column) -> Column:
    s = strip(line)
    return (ext.isin(*HASH_FAMILY) & s.startswith("#")) | (ext.isin(*C_FAMILY) & (s.startswith("//") | s.startswith("/*"))) | ((ext == ".py") & (s.startswith('"""') | s.startswith("'''"))) | ((ext == ".rb") & (s == "=begin"))


def comment_mask(lines: Column, ext: Column, long_lines_count: bool) -> Column:
    """For each line whether it is a comment; block comments span lines.

    Long lines change the state only if `long_lines_count`. Where no block can begin, lines are judged alone."""

    def opens(s: Column) -> Column:
        c = F.when(ext.isin(*C_FAMILY) & s.startswith("/*") & ~F.substring(s, 3, 1 << 20).contains("*/"), "*/")
        py = ext == ".py"
        c = c.when(py & s.startswith('"""') & ~F.substring(s, 4, 1 << 20).contains('"""'), '"""')
        c = c.when(py & s.startswith("'''") & ~F.substring(s, 4, 1 << 20).contains("'''"), "'''")
        return c.when((ext == ".rb") & (s == "=begin"), "=end").otherwise("")

    def step(state: Column, line: Column) -> Column:
        s, until = strip(line), state["until"]
        skip = (F.length(line) > LONG_LINE) & F.lit(not long_lines_count)
        closes = F.when(until == "=end", s == "=end").otherwise(s.contains(until))
        after = F.when(skip, until).when(until != "", F.when(closes, "").otherwise(until)).otherwise(opens(s))
        comment = ~skip & ((until != "") | _is_prefix_comment(line, ext))
        return F.struct(after.alias("until"), F.concat(state["mask"], F.when(comment, "1").otherwise("0")).alias("mask"))

    # By pieces of some lines, as a mask of all lines that grows by one would be copied for each of them.
    piece = lambda until, some: F.aggregate(some, F.struct(until.alias("until"), F.lit("").alias("mask")), step)
    append = lambda state, inner: F.struct(inner["until"].alias("until"), F.concat(state["mask"], inner["mask"]).alias("mask"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lines) - 1, F.lit(0)) / PIECE_LINES).cast("int")), lambda k: F.slice(lines, k * PIECE_LINES + 1, PIECE_LINES))
    fold = F.aggregate(pieces, F.struct(F.lit("").alias("until"), F.lit("").alias("mask")), lambda state, some: F.aggregate(F.array(piece(state["until"], some)), state, append), lambda s: s["mask"])
    folded = F.transform(F.split(fold, ""), lambda x: x == "1")
    whole = F.array_join(lines, "\n")
    block = (ext.isin(*C_FAMILY) & whole.contains("/*")) | ((ext == ".py") & (whole.contains('"""') | whole.contains("'''"))) | ((ext == ".rb") & whole.contains("=begin"))
    return F.when(block, folded).otherwise(F.transform(lines, lambda x: _is_prefix_comment(x, ext)))


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.length(c).cast("double")

    def share(x: Column) -> Column:
        p = (n - F.length(F.replace(c, x, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, x: a + share(x))).otherwise(F.lit(0.0))


def glob_regex(glob: str) -> str:
    """A shell pattern as an expression for the whole string; * also crosses slashes."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k:end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            k = end + 1
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
    return f"(?s)^(?:{out})$"


def rule_id(category: Column, message: Column) -> Column:
    """Prefix, category, the message before its dash as a slug, and four digits of its hash."""
    head = F.lower(strip(F.element_at(F.split(message, "—"), 1)))
    slug = F.regexp_replace(F.substring(F.regexp_replace(head, "[^a-z0-9]", "-"), 1, 60), "-+$", "")
    return F.concat_ws("-", F.lit(ID_PREFIX), F.upper(F.substring(category, 1, 3)), slug, F.substring(F.sha2(message.cast("binary"), 256), 1, 4))


# Words that mark a made-up credential. The first list counts anywhere in a value, both lists
# count where the word makes up the value, or 60 % of it.
STRONG_MARKS = (
    r"your[_\-]?\w*[_\-]?(?:key|token|secret|password|here)",
    r"replace[_\-]?me",
    r"insert[_\-]?\w*here",
    r"CHANGE[_\-]?ME",
    r"sk-ant-xxx",
    r"user:pass(?:word)?",
    r"username:password",
    r"admin:admin",
    r"root:root",
    r"(?:my|your|the)[_\-](?:user|password|secret)",
    r"<[^>]+>",
)
MARKS = (
    r"your[_\-]?\w*[_\-]?(?:key|token|secret|password|here)",
    r"replace[_\-]?me",
    r"insert[_\-]?\w*here",
    r"xxx+",
    r"TODO",
    r"CHANGE[_\-]?ME",
    r"sk-ant-xxx",
    r"example",
    r"placeholder",
    r"dummy",
    r"test[_\-]?(?:key|token|secret)",
    r"fake[_\-]?\w*",
    r"sample[_\-]?\w*",
    r"user:pass(?:word)?",
    r"username:password",
    r"admin:admin",
    r"root:root",
    r"(?:my|your|the)[_\-](?:user|password|secret)",
    r"<[^>]+>",
)
STRONG, WEAK = f"(?i)({'|'.join(STRONG_MARKS)})", f"(?i)({'|'.join(MARKS)})"


def is_placeholder(value: Column) -> Column:
    v = F.regexp_replace(strip(value), r"^['\"]+|['\"]+$", "")
    mark = F.regexp_extract(v, WEAK, 0)
    return (F.length(v) > 0) & (v.rlike(STRONG) | ((F.length(mark) > 0) & (F.length(mark) >= 0.6 * F.length(v))))
