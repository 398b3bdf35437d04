"""Canonical JSON: keys by UTF-16 code unit, numbers as ECMAScript spells them; and its SHA-256."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal
from typing import Any

from .vocab import MAX_SAFE_INTEGER


def spell_number(x: int | float) -> str:
    """An integer in the safe range, or a finite float, as ECMAScript prints it."""
    if isinstance(x, int):
        if not -MAX_SAFE_INTEGER <= x <= MAX_SAFE_INTEGER:
            raise TypeError(f"integer {x} is beyond the safe range")
        return str(x)
    if not math.isfinite(x):
        raise TypeError("numbers must be finite")
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    if x == 0:
        return "0"
    text = "".join(map(str, digits))
    point = len(text) + exponent  # the decimal point stands after so many digits
    if 0 < point <= 21:
        out = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        power = point - 1
        out = (f"{text[0]}.{text[1:]}" if len(text) > 1 else text) + f"e{'+' if power >= 0 else '-'}{abs(power)}"
    return "-" * sign + out


def canonical_json(value: Any) -> str:
    match value:
        case None | bool():
            return {None: "null", True: "true", False: "false"}[value]
        case str():
            return json.dumps(value, ensure_ascii=False)
        case int() | float():
            return spell_number(value)
        case list() | tuple():
            return f"[{','.join(map(canonical_json, value))}]"
        case dict():
            members = sorted(((str(k), v) for k, v in value.items()), key=lambda m: m[0].encode("utf-16-be", "surrogatepass"))
            return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(v)}" for k, v in members) + "}"
    raise TypeError(f"{type(value).__name__} has no canonical JSON")


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def same(a: Any, b: Any) -> bool:
    """JSON equality: 1 and 1.0 are equal, 1 and true are not."""
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b


def identity(value: Any) -> Any:
    """A hashable value, equal for what same() calls equal."""
    match value:
        case None | bool():
            return (type(value).__name__, value)
        case list():
            return ("list", tuple(map(identity, value)))
        case dict():
            return ("dict", frozenset((k, identity(v)) for k, v in value.items()))
    return value
