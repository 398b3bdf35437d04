"""Stable vocabularies and the texts of violations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

# Kinds of artifact errors, warnings, outcomes, statuses, profiles, reasons.
ARTIFACT_KINDS = (
    "artifact_unreadable", "artifact_invalid_utf8", "yaml_parse_error", "no_frontmatter", "frontmatter_not_mapping", "yaml_not_mapping", "contract_unknown", "envelope_mismatch", "envelope_ambiguous", "envelope_missing",
    "envelope_not_mapping", "document_metadata_invalid", "document_contract_mismatch", "schema_missing", "schema_invalid", "schema_violation", "enforcement_unsupported",
)
DECODE_CODES = (
    "yaml_duplicate_key", "yaml_alias", "yaml_merge_key", "yaml_custom_tag", "yaml_non_string_key", "yaml_limit",
    "number_out_of_range", "number_negative_zero", "yaml_unsupported_scalar",
)
WARNINGS = ("document-contract-mismatch", "document-status-mismatch")
OUTCOMES = ("valid", "invalid", "input_error")
STATUSES = ("soft", "permissive", "enforced")
PROFILES = ("frontmatter-md", "pure-yaml")
FAILURE_REASONS = ("syntax", "dialect", "reference", "pattern", "resource_identity", "compilation")
MAX_SAFE_INTEGER = 9007199254740991
MAX_DEPTH = 64

# What a violation of each keyword says; {v} is the value, {k} the keyword's value, both as Python writes them.
MESSAGES = {
    "enum": "value {v} is not one of [{k*}]",
    "type": "value {v} is not of type {k*}",
    "required": "required property {k} is missing",
    "minimum": "value {v} is less than the minimum of {k}",
    "maximum": "value {v} is greater than the maximum of {k}",
    "exclusiveMinimum": "value {v} is not greater than {k}",
    "exclusiveMaximum": "value {v} is not less than {k}",
    "minItems": "array is shorter than the minimum of {k} items",
    "maxItems": "array is longer than the maximum of {k} items",
    "minLength": "string is shorter than the minimum length of {k}",
    "maxLength": "string is longer than the maximum length of {k}",
    "pattern": "value {v} does not match pattern {k}",
    "additionalProperties": "object has properties that are not allowed",
    "multipleOf": "value {v} is not a multiple of {k}",
}
OTHER_MESSAGE = "value {v} failed {name} constraint {k}"


@dataclass(frozen=True)
class Dialect:
    """Names by which documents and schemas speak to this engine; a corpus written for another tool brings its own."""

    name: str = "fathom"

    @property
    def meta_key(self) -> str:
        """Top-level key of a document's metadata."""
        return self.name

    @property
    def annotation(self) -> str:
        """Schema keyword that holds annotations."""
        return f"x-{self.name}"

    @property
    def marker(self) -> str:
        """What a generated section's comment begins with."""
        return f"{self.name}:generated"


def whole(value):
    """Numbers as JSON writes them: a whole float in the safe range is an integer, in containers too."""
    if isinstance(value, float) and value.is_integer() and abs(value) <= MAX_SAFE_INTEGER:
        return int(value)
    if isinstance(value, (list, tuple)):
        return type(value)(whole(v) for v in value)
    return {k: whole(v) for k, v in value.items()} if isinstance(value, dict) else value


def shown(value) -> str:
    """A value as Python's repr writes it, but whole floats below 1e21 as integers, by their shortest digits."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(Decimal(repr(value))))
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, list):
        return "[" + ", ".join(map(shown, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k!r}: {shown(v)}" for k, v in value.items()) + "}"
    return repr(value)


def template(keyword: str) -> str:
    return MESSAGES.get(keyword, OTHER_MESSAGE.replace("{name}", keyword))


def keyword_text(keyword: str, limit) -> str:
    """The template with the keyword's value filled in; {v} stays."""
    text = template(keyword)
    listed = ", ".join(map(shown, limit)) if isinstance(limit, (list, tuple)) else shown(limit)
    head, mark, tail = text.partition("{k*}")
    if mark:
        return head + listed + tail
    head, mark, tail = text.partition("{k}")
    return head + shown(limit) + tail if mark else text


def message(keyword: str, limit, value) -> str:
    head, mark, tail = template(keyword).partition("{v}")
    if not mark:
        return keyword_text(keyword, limit)
    before, _, after = keyword_text(keyword, limit).partition("{v}")
    return before + shown(value) + after
