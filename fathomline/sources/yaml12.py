"""The portable YAML domain: the core scalar rules of YAML 1.2 over PyYAML's events, without tags, anchors or merges."""

from __future__ import annotations

import math
import re
from typing import Any

import yaml

from fathomline.functions.vocab import MAX_DEPTH, MAX_SAFE_INTEGER

_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
# The core schema's plain scalars.
_NULL = {"", "~", "null", "Null", "NULL"}
_BOOL = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
_SPECIAL = re.compile(r"([-+]?)\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")


class Rejected(ValueError):
    """code is one of vocab.DECODE_CODES, yaml_parse_error or artifact_invalid_utf8."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def scalar(text: str) -> Any:
    """What a plain scalar means; dates stay text."""
    if text in _NULL:
        return None
    if text in _BOOL:
        return _BOOL[text]
    if _INT.fullmatch(text):
        return int(text, 0) if text[:2] in ("0o", "0x") else int(text) if len(text) < 400 else 10**399
    if _FLOAT.fullmatch(text):
        return float(text)
    if m := _SPECIAL.fullmatch(text):
        return math.nan if m[1] is None else math.inf * (-1 if m[1] == "-" else 1)
    return text


class _Open:
    """A collection whose end has not come yet."""

    def __init__(self, value: dict | list) -> None:
        self.value, self.key, self.waiting = value, None, isinstance(value, dict)

    def expects_key(self) -> bool:
        return isinstance(self.value, dict) and self.waiting


def decode(text: str) -> Any:
    """The one document in text. Raises Rejected; of several reasons the first in this order: whatever of tag, merge key,
    depth and syntax comes first in the text, then alias, then duplicate key, then values (last sibling first)."""
    stack: list[_Open] = []
    found: list[Any] = []
    alias = duplicate = False
    documents = 0

    def put(value: Any) -> None:
        nonlocal duplicate
        if not stack:
            found.append(value)
            return
        top = stack[-1]
        if isinstance(top.value, list):
            top.value.append(value)
        elif top.waiting:
            top.key, top.waiting = value, False
        else:
            key = top.key
            if not isinstance(key, str):
                key = ("odd", repr(key))
            if key in top.value:
                duplicate = True
            top.value[key] = value
            top.waiting = True

    try:
        for event in yaml.parse(text, Loader=_LOADER):
            if isinstance(event, yaml.DocumentStartEvent):
                documents += 1
                continue
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None) is not None:
                alias = True
            if getattr(event, "tag", None) is not None:
                raise Rejected("yaml_custom_tag", "explicit YAML tags are not supported")
            match event:
                case yaml.AliasEvent():
                    put(None)
                case yaml.ScalarEvent():
                    if event.value == "<<" and stack and stack[-1].expects_key():
                        raise Rejected("yaml_merge_key", "YAML merge keys are not supported")
                    put(scalar(event.value) if event.implicit[0] and not event.style else event.value)
                case yaml.MappingStartEvent() | yaml.SequenceStartEvent():
                    stack.append(_Open({} if isinstance(event, yaml.MappingStartEvent) else []))
                    if len(stack) > MAX_DEPTH:
                        raise Rejected("yaml_limit", "YAML nesting exceeds the depth limit")
                case yaml.MappingEndEvent() | yaml.SequenceEndEvent():
                    put(stack.pop().value)
    except yaml.YAMLError as e:
        raise Rejected("yaml_parse_error", str(e)) from e
    except RecursionError as e:
        raise Rejected("yaml_limit", "YAML nesting exhausted the parser stack") from e
    if alias:
        raise Rejected("yaml_alias", "YAML aliases and anchors are not supported")
    if documents > 1:
        raise Rejected("yaml_parse_error", "expected a single document in the stream")
    if duplicate:
        raise Rejected("yaml_duplicate_key", "found duplicate key")
    value = found[0] if found else None
    check_portable(value)
    return value


def check_portable(value: Any) -> None:
    """Raises Rejected for what not every host's JSON values can hold alike."""
    match value:
        case None | bool():
            return
        case str():
            if any("\ud800" <= c <= "\udfff" for c in value):
                raise Rejected("yaml_unsupported_scalar", "lone surrogate is not supported")
        case int():
            if abs(value) > MAX_SAFE_INTEGER:
                raise Rejected("number_out_of_range", "integer exceeds the safe range")
        case float():
            if not math.isfinite(value):
                raise Rejected("number_out_of_range", "number must be finite")
            if value == 0 and math.copysign(1, value) < 0:
                raise Rejected("number_negative_zero", "negative zero is not supported")
        case list():
            for v in reversed(value):
                check_portable(v)
        case dict():
            if not all(isinstance(k, str) for k in value):
                raise Rejected("yaml_non_string_key", "mapping keys must be strings")
            for v in reversed(value.values()):
                check_portable(v)
        case _:
            raise Rejected("yaml_unsupported_scalar", f"unsupported YAML value: {type(value).__name__}")
