"""Ignore rules (P1, S4): gitignore patterns as regular expressions.

A rule is matched against a path whose directories end in ``/``.  The last
matching rule decides, and an ignored directory takes its subtree with it.
Rules come either from the driver (the same list for every repository, so
the patterns are literals compiled once) or from each repository's own root
``.gitignore``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import groupby, product

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.paths import ancestors, rlike_with

# Fixed value: the patterns every repository ignores.
DEFAULT_PATTERNS = [
    "node_modules", ".git", "dist", "build", ".env", ".env.*", "*.pem", "*.key", "*.id_rsa",
    "*.id_ed25519", "*.p12", "*.pfx", "*.kdbx", "*.keystore", ".DS_Store", "coverage",
    ".npmrc", ".pypirc",
]

RULES_TYPE = "array<struct<regex:string,negated:boolean>>"


@dataclass(frozen=True)
class Pattern:
    """One ignore line: a glob as a regex body and where it applies."""

    body: str
    anchored: bool
    directory: bool
    negated: bool
    needed: str = ""


@dataclass(frozen=True)
class Rule:
    """A run of patterns of one sign as a single regex over ``dir/`` or ``file``.

    ``needed`` are parts of which every match holds one, in lower case; empty
    when some pattern can do without any.
    """

    regex: str
    below: str
    negated: bool
    needed: tuple[str, ...] = ()


def _quoted(char: str) -> str:
    return char if char.isalnum() or char in "_/" or ord(char) > 127 else "\\" + char


def _class_body(inner: str) -> str:
    """The inside of ``[...]`` as a regex class; a range that runs backwards holds nothing, and an empty class matches nothing."""
    negate = inner[0] in "!^" and len(inner) > 1
    chars = re.findall(r"\\?.", inner[1:] if negate else inner, re.DOTALL)
    members, i = "", 0
    while i < len(chars):
        first = chars[i][-1]
        if chars[i + 1:i + 2] == ["-"] and i + 2 < len(chars):
            last = chars[i + 2][-1]
            members += f"{_quoted(first)}-{_quoted(last)}" if first <= last else ""
            i += 3
        else:
            members += _quoted(first)
            i += 1
    if negate:
        return f"[^/{members}]"
    return f"[{members}]" if members else "(?!)"


def _glob_body(glob: str) -> str:
    """Translate one slash-free-ended glob to a regex body."""
    out, i = [], 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/") and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif rest == "**" and i > 0 and glob[i - 1] == "/":
            out.append(".+")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += len(rest) - len(rest.lstrip("*"))
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and (closed := re.match(r"\[[^\\]?(?:\\.|[^\\\]])*\]", rest, re.DOTALL)) and closed.end() > 2:
            out.append(_class_body(rest[1:closed.end() - 1]))
            i += closed.end()
        else:
            if glob[i] == "\\" and len(rest) > 1:
                i += 1
            out.append(_quoted(glob[i]))
            i += 1
    return "".join(out)


def compile_pattern(line: str) -> Pattern | None:
    """Compile one line of an ignore file; None for blanks and comments."""
    glob = line.rstrip("\r")
    while glob.endswith(" ") and not glob.endswith("\\ "):
        glob = glob[:-1]
    if not glob or glob.startswith("#"):
        return None
    negated = glob.startswith("!")
    glob = glob[1:] if negated else glob
    directory = glob.endswith("/")
    glob = glob.rstrip("/") if directory else glob
    anchored = "/" in glob
    glob = glob.lstrip("/")
    return Pattern(_glob_body(glob), anchored, directory, negated, _needed(glob)) if glob else None


def _needed(glob: str) -> str:
    """The longest plain part of a glob, in lower case; empty for globs with classes, escapes or letters beyond ASCII."""
    if not glob.isascii() or re.search(r"[\[\]\\]", glob):
        return ""
    return max(re.split(r"[*?/]+", glob), key=len).lower()


def _merge(run: list[Pattern]) -> Rule:
    """One regex for a run: alternatives share the head and tail they have in common.

    ``regex`` tests a path that ends at the entry, ``below`` finds the entry or
    any directory above it in a longer path.
    """
    ends, inside = [], []
    for anchored, directory in product((False, True), repeat=2):
        bodies = [p.body for p in run if (p.anchored, p.directory) == (anchored, directory)]
        if bodies:
            body = f"{'^' if anchored else '(?:^|/)'}(?:{'|'.join(bodies)})"
            ends.append(body + ("/$" if directory else "/?$"))
            inside.append(body + ("/" if directory else "(?:/|$)"))
    needed = tuple(p.needed for p in run) if all(p.needed for p in run) else ()
    return Rule("(?i)" + "|".join(ends), "(?i)" + "|".join(inside), run[0].negated, needed)


def compile_patterns(lines: Iterable[str]) -> list[Rule]:
    """Compile a whole ignore file, in order; runs of equal sign are merged.

    Within a run of patterns that all ignore (or all re-include) only "does
    any match" matters, so a file needs one regex per change of sign.
    """
    patterns = filter(None, map(compile_pattern, lines))
    return [_merge(list(run)) for _, run in groupby(patterns, key=lambda p: p.negated)]


def entry_paths(path: Column, is_dir: Column | bool = False) -> Column:
    """Every ancestor as ``dir/`` followed by the entry itself."""
    directory = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    own = F.when(directory, F.concat(path, F.lit("/"))).otherwise(path)
    return F.array_append(F.transform(ancestors(path), lambda d: F.concat(d, F.lit("/"))), own)


def verdict(entry: Column, rules: Sequence[Rule]) -> Column:
    """True/False from the last matching literal rule, NULL when none matches."""
    decided = F.lit(None).cast("boolean")
    for rule in rules:
        decided = F.when(F.rlike(entry, F.lit(rule.regex)), F.lit(not rule.negated)).otherwise(decided)
    return decided


def is_ignored(
    path: Column,
    is_dir: Column | bool = False,
    patterns: Sequence[str] = (),
    repo_rules: Column | None = None,
) -> Column:
    """Whether the entry or a directory above it is ignored.

    ``patterns`` follow the defaults for every row; ``repo_rules`` is an
    optional column of type ``RULES_TYPE`` that follows both.
    """
    rules = compile_patterns([*DEFAULT_PATTERNS, *patterns])
    directory = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    own = F.when(directory, F.concat(path, F.lit("/"))).otherwise(path)
    # without a re-including rule one regex over the whole path decides
    simple = None
    if not any(r.negated for r in rules):
        below, needed = rules[0].below, rules[0].needed
        simple = rlike_with(own, below, needed) if needed else F.rlike(own, F.lit(below))
    if simple is not None and repo_rules is None:
        return simple

    def ignored(entry: Column) -> Column:
        common = F.coalesce(verdict(entry, rules), F.lit(False))
        if repo_rules is None:
            return common
        hits = F.filter(repo_rules, lambda r: F.regexp(entry, r["regex"]))
        last = F.try_element_at(hits, F.lit(-1))
        return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, ~last["negated"]).otherwise(common)

    walked = F.exists(entry_paths(path, is_dir), ignored)
    if simple is None:
        return walked
    return F.when(F.coalesce(F.size(repo_rules), F.lit(0)) <= 0, simple).otherwise(walked)
