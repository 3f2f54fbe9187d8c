"""What a line must contain to match a pattern: required three-character grams.

Grams are taken from folded text, in which characters that a case-insensitive
match treats as equal are one character.  A *need* is a set of grams of which
one must occur; all needs of a pattern must be met.  Whatever is not
understood is not required, so a pattern without needs may match anything.
"""

from __future__ import annotations

import sys
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 3
# A need may list so many grams; sets of characters beyond it are not spelled out.
MOST_CHOICES = 64

_CASE_PARTNERS = {
    lower: lower.upper().lower()
    for lower in map(chr, range(128, min(sys.maxunicode, 0xFFFF) + 1))
    if lower.lower() == lower and len(lower.upper()) == 1 and len(lower.upper().lower()) == 1 and lower.upper().lower() != lower
}
# Lower-casing a capital I with a dot leaves a combining dot, which no match asks for.
_DOT = "̇"
_FROM, _TO = "".join(_CASE_PARTNERS) + _DOT, "".join(_CASE_PARTNERS.values())


def fold(text: Column) -> Column:
    """Lower case, with the few lower-case characters that share a capital made one."""
    return F.translate(F.lower(text), _FROM, _TO)


def folded(text: str) -> str:
    """:func:`fold` of one string."""
    return text.lower().translate(str.maketrans(_FROM[:-1], _TO, _DOT))


def grams(text: Column) -> Column:
    """The distinct grams of a text, none of which spans two lines."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"(?=([^\n]{3}))"), F.lit(1)))


def _needs_of_run(run: list[set[str]]) -> list[set[str]]:
    """The grams of a run of neighbouring characters, each one of a set."""
    needs = []
    for at in range(len(run) - SIZE + 1):
        window = run[at:at + SIZE]
        if len(window[0]) * len(window[1]) * len(window[2]) <= MOST_CHOICES:
            needs.append({"".join(chars) for chars in product(*window)})
    return needs


def literal_needs(query: str) -> list[set[str]]:
    """Needs of a plain text: every gram of it."""
    return _needs_of_run([{c} for c in folded(query)])


class _Unknown(Exception):
    """Syntax whose meaning is not told here."""


# Escapes that stand for a kind of character or a place, and those that stand for one character.
_KINDS = set("dDwWsShHvVRbBAzZG")
_CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}


class _Reader:
    """Reads a pattern from left to right and collects what it requires."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at:self.at + n]

    def take(self) -> str:
        if self.at >= len(self.pattern):
            raise _Unknown
        self.at += 1
        return self.pattern[self.at - 1]

    def alternatives(self) -> list[set[str]]:
        """Needs of ``a|b|...`` up to a closing bracket or the end."""
        branches = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        # one of the branches matches, so one gram of each branch's narrowest need occurs
        if not all(branches):
            return []
        return [set().union(*(min(b, key=len) for b in branches))]

    def sequence(self) -> list[set[str]]:
        needs: list[set[str]] = []
        run: list[set[str]] = []
        while self.peek() not in ("", "|", ")"):
            chars, inner = self.atom()
            least, most = self.quantifier()
            if chars is not None and least >= 1:
                run.append(chars)
            if chars is None or (least, most) != (1, 1):
                needs += _needs_of_run(run)
                # what follows a repeated character stands next to its last occurrence
                run = [chars] if chars is not None and least >= 1 else []
            if least >= 1:
                needs += inner
        return needs + _needs_of_run(run)

    def atom(self) -> tuple[set[str] | None, list[set[str]]]:
        """The characters that one place may hold (``None``: not told), and needs of a group."""
        char = self.take()
        if char == "(":
            return None, self.group()
        if char == "[":
            return self.char_class(), []
        if char == "\\":
            return self.escape(), []
        if char in ".^$":
            return None, []
        if char in "*+?{":
            raise _Unknown
        return self.one(char), []

    def one(self, char: str) -> set[str] | None:
        same = folded(char)
        return {same} if len(same) == 1 and same != "\n" else None

    def group(self) -> list[set[str]]:
        counts = True
        if self.peek() == "?":
            self.at += 1
            kind = self.take()
            if kind in "=!" or (kind == "<" and self.peek() in ("=", "!")):
                counts = False
                self.at += kind == "<"
            elif kind == "<":
                while self.take() != ">":
                    pass
            elif kind not in ":>":
                raise _Unknown
        needs = self.alternatives()
        if self.take() != ")":
            raise _Unknown
        return needs if counts else []

    def escape(self) -> set[str] | None:
        char = self.take()
        if char in _KINDS:
            return None
        if char in _CONTROLS:
            return self.one(_CONTROLS[char])
        if char.isascii() and char.isalnum():
            raise _Unknown
        return self.one(char)

    def char_class(self) -> set[str] | None:
        """Single characters and ranges; anything else makes the place untold."""
        told, chars = self.peek() != "^", set()
        self.at += not told
        first = True
        while first or self.peek() != "]":
            char = self.take()
            first = False
            if char == "[" or self.peek(2) == "&&" or (char == "&" and self.peek() == "&"):
                raise _Unknown
            if char == "\\":
                kept = self.escape()
            else:
                kept = self.one(char)
            if kept is None:
                told = False
            elif self.peek() == "-" and self.peek(2) != "-]":
                self.at += 1
                last = self.take()
                if last in "[\\":
                    raise _Unknown
                if char == "\\" or ord(last) - ord(char) >= MOST_CHOICES:
                    told = False
                else:
                    spelled = [self.one(chr(code)) for code in range(ord(char), ord(last) + 1)]
                    told = told and None not in spelled
                    chars |= set().union(*filter(None, spelled))
            else:
                chars |= kept
        self.at += 1
        return chars if told and chars else None

    def quantifier(self) -> tuple[int, int | None]:
        char = self.peek()
        if char not in ("*", "+", "?", "{"):
            return 1, 1
        self.at += 1
        if char == "{":
            inner = ""
            while (digit := self.take()) != "}":
                inner += digit
            low, comma, high = inner.partition(",")
            if not low.isdigit() or (high and not high.isdigit()):
                raise _Unknown
            least, most = int(low), (int(high) if high else None) if comma else int(low)
        else:
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[char]
        if self.peek() in ("?", "+"):
            self.at += 1
        if self.peek() in ("*", "+", "?", "{"):
            raise _Unknown
        return least, most


def regex_needs(pattern: str) -> list[set[str]]:
    """Needs of a regular expression that ignores case; none where its syntax is not told here."""
    reader = _Reader(pattern)
    try:
        needs = reader.alternatives()
    except (_Unknown, RecursionError):
        return []
    return needs if reader.at == len(pattern) else []
