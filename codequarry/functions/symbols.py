"""Symbol columns (C15-C28): one declaration per source line, by language."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.paths import contains_any
from codequarry.functions.text import js_trim, split_lines

# Language families by extension and their declaration patterns.
MARKDOWN = [".md", ".markdown"]
SCRIPT = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
PYTHON = [".py"]
GO = [".go"]
RUST = [".rs"]
BRACED = [".java", ".kt", ".cs", ".php", ".cpp", ".c", ".h"]

SCRIPT_TYPE_WORDS = ["class", "interface", "type", "enum"]
RUST_WORDS = ["fn", "struct", "enum", "trait", "impl", "type"]
BRACED_CLASS_WORDS = ["class", "interface", "trait", "enum", "struct"]

COMMENT_STARTS = ["//", "#", "/*", "*"]

HEADING = r"^(#{1,6})\s+(.*)$"
SCRIPT_TYPE = r"^(export\s+)?(default\s+)?(abstract\s+)?(class|interface|type|enum)\s+([A-Za-z0-9_$]+)"
SCRIPT_FUNCTION = r"^(export\s+)?(default\s+)?(async\s+)?function(\s*\*|\s+)?([A-Za-z0-9_$]+)?\s*\("
SCRIPT_ARROW = (
    r"^(export\s+)?(const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(async\s*)?(\([^)]*\)|[A-Za-z0-9_$]+)\s*=>"
)
SCRIPT_METHOD = (
    r"^(public|private|protected|static|async|override|get|set|\*)*\s*([A-Za-z0-9_$]+)"
    r"\s*\([^)]*\)\s*(:\s*[^;{]+)?\s*\{"
)
SCRIPT_CONTROL = r"^(if|switch|for|while|catch)\b"
PYTHON_CLASS = r"^class\s+([A-Za-z0-9_]+)(\(.*?\))?:"
PYTHON_DEF = r"^(\s*)(async\s+)?def\s+([A-Za-z0-9_]+)\s*\("
GO_FUNC = r"^func\s*(\(.*?\)\s*)?([A-Za-z0-9_]+)\s*\("
GO_TYPE = r"^type\s+([A-Za-z0-9_]+)\s+(struct|interface)"
RUST_ITEM = r"^(pub(\(.*?\))?\s+)?(async\s+)?(fn|struct|enum|trait|impl|type)\s+([A-Za-z0-9_]+)"
BRACED_CLASS = (
    r"^((public|protected|private|internal|static|final|abstract|sealed|open|data|export)\s+)*"
    r"(enum\s+class|class|interface|trait|enum|struct)\s+([A-Za-z0-9_]+)"
)
BRACED_FUNCTION = (
    r"^(public|protected|private|static|async|function)?\s*([A-Za-z0-9_<>\[\]]+)\s+"
    r"([A-Za-z0-9_]+)\s*\([^)]*\)\s*\{"
)
BRACED_CONTROL = r"^(if|else|switch|for|while|catch)\b"


def is_comment(trimmed: Column, heading: bool = False) -> Column:
    """Blank or comment-like line; ``#`` may open a ``heading``."""
    skip = trimmed == ""
    for start in COMMENT_STARTS:
        if not (heading and start == "#"):
            skip = skip | F.startswith(trimmed, F.lit(start))
    return skip


def _has(line: Column, pattern: str, *parts: str) -> Column:
    """Whether the pattern is found; the literal parts a match cannot do without are looked for first."""
    test = F.rlike(line, F.lit(pattern))
    for part in reversed(parts):
        test = F.contains(line, F.lit(part)) & test
    return test


def _script_kind(raw: Column, trimmed: Column) -> Column:
    return (
        F.when(contains_any(trimmed, SCRIPT_TYPE_WORDS) & _has(trimmed, SCRIPT_TYPE), F.regexp_extract(trimmed, SCRIPT_TYPE, 4))
        .when(_has(trimmed, SCRIPT_FUNCTION, "function", "(") | _has(trimmed, SCRIPT_ARROW, "=>"), F.lit("function"))
        .when(_has(trimmed, SCRIPT_METHOD, "(", "{") & ~_has(trimmed, SCRIPT_CONTROL), F.lit("method"))
    )


def _python_kind(raw: Column, trimmed: Column) -> Column:
    return (
        F.when(_has(raw, PYTHON_CLASS, "class", ":"), F.lit("class"))
        .when(_has(raw, PYTHON_DEF, "def", "("),
              F.when(F.regexp_extract(raw, PYTHON_DEF, 1) != "", F.lit("method")).otherwise(F.lit("function")))
    )


def _heading_kind(raw: Column, trimmed: Column) -> Column:
    return F.when(_has(raw, HEADING), F.concat(F.lit("h"), F.length(F.regexp_extract(raw, HEADING, 1))))


def _go_kind(raw: Column, trimmed: Column) -> Column:
    return (
        F.when(_has(trimmed, GO_FUNC, "func", "("),
               F.when(F.regexp_extract(trimmed, GO_FUNC, 1) != "", F.lit("method")).otherwise(F.lit("function")))
        .when(_has(trimmed, GO_TYPE, "type"), F.regexp_extract(trimmed, GO_TYPE, 2))
    )


def _rust_kind(raw: Column, trimmed: Column) -> Column:
    return F.when(_has(trimmed, RUST_ITEM), F.regexp_extract(trimmed, RUST_ITEM, 4))


def _braced_kind(raw: Column, trimmed: Column) -> Column:
    return (
        F.when(contains_any(trimmed, BRACED_CLASS_WORDS) & _has(trimmed, BRACED_CLASS), F.regexp_extract(trimmed, BRACED_CLASS, 3))
        .when(_has(trimmed, BRACED_FUNCTION, "(", "{") & ~_has(trimmed, BRACED_CONTROL), F.lit("function"))
    )


def _heading(raw: Column, trimmed: Column) -> Column:
    return F.concat(F.regexp_extract(raw, HEADING, 1), F.lit(" "), js_trim(F.regexp_extract(raw, HEADING, 2)))


def _unopened(raw: Column, trimmed: Column) -> Column:
    """The declaration without its body opener."""
    return js_trim(F.substring_index(trimmed, "{", 1))


def _uncoloned(raw: Column, trimmed: Column) -> Column:
    return js_trim(F.regexp_replace(trimmed, ":$", ""))


def _both(line: Column, *parts: str) -> Column:
    return reduce(and_, [F.contains(line, F.lit(p)) for p in parts])


# Of each family: its extensions, what a line with a declaration cannot do without, its kind (first rule wins, C28) and signature.
FAMILIES: list[tuple[list[str], Callable[[Column], Column], Callable[..., Column], Callable[..., Column]]] = [
    (SCRIPT, lambda line: _both(line, "(", "{") | contains_any(line, [*SCRIPT_TYPE_WORDS, "function", "=>"]), _script_kind, _unopened),
    (PYTHON, lambda line: contains_any(line, ["class", "def"]), _python_kind, _uncoloned),
    (MARKDOWN, lambda line: F.contains(line, F.lit("#")), _heading_kind, _heading),
    (GO, lambda line: contains_any(line, ["func", "type"]), _go_kind, _unopened),
    (RUST, lambda line: contains_any(line, RUST_WORDS), _rust_kind, _unopened),
    (BRACED, lambda line: _both(line, "(", "{") | contains_any(line, BRACED_CLASS_WORDS), _braced_kind, _unopened),
]


def symbol_array(text: Column, ext: Column) -> Column:
    """``array<struct<line_no,kind,signature>>`` of LF text, in line order.

    ``ext`` is the lower-cased extension.  The family is chosen once for a
    file; lines that lack what its declarations need are left out before they
    are trimmed, and a signature is only built for a line with a kind.
    """
    def declared(may: Callable[[Column], Column], kind: Callable[..., Column], signature: Callable[..., Column], heading: bool) -> Column:
        numbered = F.transform(split_lines(text), lambda raw, i: F.struct((i + 1).alias("line_no"), raw.alias("raw")))
        trimmed = F.transform(F.filter(numbered, lambda x: may(x["raw"])), lambda x: F.struct(
            x["line_no"].alias("line_no"), x["raw"].alias("raw"), js_trim(x["raw"]).alias("trimmed")))
        kinds = F.transform(trimmed, lambda x: F.struct(
            x["line_no"].alias("line_no"), x["raw"].alias("raw"), x["trimmed"].alias("trimmed"),
            F.when(~is_comment(x["trimmed"], heading), kind(x["raw"], x["trimmed"])).alias("kind")))
        return F.transform(F.filter(kinds, lambda x: x["kind"].isNotNull()), lambda x: F.struct(
            x["line_no"].alias("line_no"), x["kind"].alias("kind"), signature(x["raw"], x["trimmed"]).alias("signature")))

    found = None
    for exts, may, kind, signature in FAMILIES:
        own = declared(may, kind, signature, exts is MARKDOWN)
        found = F.when(ext.isin(exts), own) if found is None else found.when(ext.isin(exts), own)
    return found.otherwise(F.array().cast("array<struct<line_no:int,kind:string,signature:string>>"))
