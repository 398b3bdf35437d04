"""Patterns as syntax trees: simplified where that can't change what they find, and written in Java's dialect with Python's meaning.

A pattern here only says whether it is found somewhere in a text, so groups need not be remembered, and a repetition of
a repetition is one repetition: (a+)+, which takes exponential time to fail as it stands, is a+."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from re import _constants as ops  # what re itself compiles from
from re import _parser
from typing import Any

#: Classes of characters in Java that mean what Python's categories mean over all of Unicode.
CATEGORIES = {
    ops.CATEGORY_DIGIT: r"\p{Nd}", ops.CATEGORY_SPACE: r"\s\x1c-\x1f", ops.CATEGORY_WORD: r"\p{L}\p{N}_",
}
NEGATED = {ops.CATEGORY_NOT_DIGIT: ops.CATEGORY_DIGIT, ops.CATEGORY_NOT_SPACE: ops.CATEGORY_SPACE, ops.CATEGORY_NOT_WORD: ops.CATEGORY_WORD}
_AFTER, _BEFORE, _NOT_AFTER, _NOT_BEFORE = (f"({look}[{CATEGORIES[ops.CATEGORY_WORD]}])" for look in ("?<=", "?=", "?<!", "?!"))
#: Java's own \b is about other characters; in an empty text Python finds no place of either kind.
PLACES = {
    ops.AT_BEGINNING: "^", ops.AT_BEGINNING_STRING: r"\A", ops.AT_END: r"(?=\n?\z)", ops.AT_END_STRING: r"\z",
    ops.AT_BOUNDARY: f"(?:{_AFTER}{_NOT_BEFORE}|{_NOT_AFTER}{_BEFORE})", ops.AT_NON_BOUNDARY: rf"(?!\A\z)(?:{_AFTER}{_BEFORE}|{_NOT_AFTER}{_NOT_BEFORE})",
}
PYTHON_PLACES = {ops.AT_BEGINNING: "^", ops.AT_BEGINNING_STRING: r"\A", ops.AT_END: "$", ops.AT_END_STRING: r"\Z", ops.AT_BOUNDARY: r"\b", ops.AT_NON_BOUNDARY: r"\B"}
PYTHON_CATEGORIES = {ops.CATEGORY_DIGIT: r"\d", ops.CATEGORY_SPACE: r"\s", ops.CATEGORY_WORD: r"\w"}
REPEATS = {ops.MAX_REPEAT: "", ops.MIN_REPEAT: "?", ops.POSSESSIVE_REPEAT: "+"}


class Unsayable(ValueError):
    """The pattern depends on what a group has matched."""


def simple(items: list[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
    """The sequence without remembered groups, repeated repetitions and repeated alternatives."""
    out = []
    for op, arg in items:
        if op is ops.SUBPATTERN:
            if arg[1] or arg[2]:
                raise Unsayable("flags of a group")
            inner = simple(list(arg[3]))
            out += inner if len(inner) == 1 and inner[0][0] is not ops.BRANCH else [(ops.SUBPATTERN, (None, 0, 0, inner))]
        elif op in REPEATS:
            low, high, body = arg[0], arg[1], simple(list(arg[2]))
            while op is ops.MAX_REPEAT and high is ops.MAXREPEAT and low <= 1 and len(body) == 1 and body[0][0] is op and body[0][1][1] is ops.MAXREPEAT and body[0][1][0] <= 1:
                low, body = low * body[0][1][0], body[0][1][2]
            out.append((op, (low, high, body)))
        elif op is ops.BRANCH:
            ways: list[list] = []
            for way in map(lambda w: simple(list(w)), arg[1]):
                if way not in ways:
                    ways.append(way)
            out += ways[0] if len(ways) == 1 else [(op, (None, ways))]
        elif op is ops.ATOMIC_GROUP:
            out.append((op, simple(list(arg))))
        elif op in (ops.ASSERT, ops.ASSERT_NOT):
            out.append((op, (arg[0], simple(list(arg[1])))))
        elif op in (ops.GROUPREF, ops.GROUPREF_EXISTS):
            raise Unsayable("a reference to a group")
        else:
            out.append((op, arg))
    return out


def _char(code: int) -> str:
    return chr(code) if code < 128 and chr(code).isalnum() else rf"\x{{{code:x}}}"


def _python_char(code: int) -> str:
    return chr(code) if code < 128 and chr(code).isalnum() else rf"\U{code:08x}"


def _class(items: list[tuple[Any, Any]], char: Callable[[int], str], named: dict[Any, str], python: bool) -> str:
    out = ""
    for op, arg in items:
        if op is ops.NEGATE:
            out = "^"
        elif op is ops.LITERAL:
            out += char(arg)
        elif op is ops.RANGE:
            out += f"{char(arg[0])}-{char(arg[1])}"
        elif arg in named:
            out += named[arg]
        else:
            out += rf"{named[NEGATED[arg]].upper()}" if python else f"[^{named[NEGATED[arg]]}]"
    return f"[{out}]"


def written(items: list[tuple[Any, Any]], python: bool = False) -> str:
    """The sequence as a pattern in Java's dialect, or in Python's."""
    char, named, places = (_python_char, PYTHON_CATEGORIES, PYTHON_PLACES) if python else (_char, CATEGORIES, PLACES)
    below = lambda inner: written(list(inner), python)
    out = ""
    for op, arg in items:
        if op is ops.LITERAL:
            out += char(arg)
        elif op is ops.NOT_LITERAL:
            out += f"[^{char(arg)}]"
        elif op is ops.ANY:
            out += r"[^\n]"
        elif op is ops.IN:
            out += _class(arg, char, named, python)
        elif op is ops.AT:
            out += places[arg]
        elif op in REPEATS:
            low, high, body = arg
            out += f"(?:{below(body)}){{{low},{'' if high is ops.MAXREPEAT else high}}}{REPEATS[op]}"
        elif op is ops.SUBPATTERN:
            out += f"(?:{below(arg[3])})"
        elif op is ops.BRANCH:
            out += f"(?:{'|'.join(map(below, arg[1]))})"
        elif op is ops.ATOMIC_GROUP:
            out += f"(?>{below(arg)})"
        elif op in (ops.ASSERT, ops.ASSERT_NOT):
            out += f"(?{'' if arg[0] >= 0 else '<'}{'=' if op is ops.ASSERT else '!'}{below(arg[1])})"
        elif op is ops.FAILURE:
            out += "(?!)"
        else:
            raise Unsayable(f"{op} in a pattern")
    return out


@functools.lru_cache(maxsize=1024)
def java(pattern: str) -> str:
    """The pattern in Java's dialect: Unsayable where it refers to groups. Only \\n ends a line."""
    return f"(?Ud){written(simple(list(_parser.parse(pattern))))}"


@functools.lru_cache(maxsize=1024)
def python(pattern: str) -> re.Pattern:
    """The pattern compiled in its simpler form; as it is where that can't be written."""
    try:
        return re.compile(written(simple(list(_parser.parse(pattern))), python=True))
    except Unsayable:
        return re.compile(pattern)
