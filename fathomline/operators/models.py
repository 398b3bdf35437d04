"""Code models to schemas: annotated fields, compilation, identity hash, drift."""

from __future__ import annotations

import importlib
import os
import tempfile
from dataclasses import dataclass
from pathlib import Path
from typing import Any
from urllib.parse import urlparse

import yaml

from fathomline.functions.canonical import digest
from fathomline.functions.vocab import Dialect
from fathomline.plans.schema_tree import canonicalize
from fathomline.sources.yaml12 import decode

DRAFT = "https://json-schema.org/draft/2020-12/schema"
ANNOTATIONS = ("group", "order", "tier", "owner", "instruction", "examples", "aliases", "repair")


def annotated(default: Any = ..., *, dialect: Dialect = Dialect(), description: str | None = None, **notes: Any):
    """A pydantic field with annotations (ANNOTATIONS); None and empty ones are left out, an empty text is refused."""
    from pydantic import Field

    for key, value in notes.items():
        if key not in ANNOTATIONS:
            raise ValueError(f"unknown annotation {key!r}")
        if value == "":
            raise ValueError(f"annotation {key!r} must not be empty")
    kept = {k: v for k, v in notes.items() if v is not None and v != [] and v != {}}
    return Field(default, description=description, json_schema_extra={dialect.annotation: kept} if kept else None)


@dataclass(frozen=True)
class Compiled:
    schema: dict
    schema_yaml: str
    schema_sha256: str


def compile_model(model: type, contract_id: str, schema_id: str | None = None, dialect: Dialect = Dialect()) -> Compiled:
    """The model's canonical schema; the hash is taken before it is put into the schema."""
    import re

    from .binding import CONTRACT_ID

    if not re.match(CONTRACT_ID.replace(r"\z", r"\Z"), contract_id):
        raise ValueError(f"malformed contract ID {contract_id!r}")
    if schema_id is not None and not urlparse(schema_id).scheme:
        raise ValueError("schema_id must be an absolute URI")
    raw = model.model_json_schema()
    if dialect.annotation in raw or "$id" in raw:
        raise ValueError("model schema uses a compiler-reserved root identity key")
    if model.model_config.get("title") is None:
        raw["title"] = contract_id.rpartition(":")[2].partition("/")[0]
    raw = {"$schema": DRAFT, **raw, **({"$id": schema_id} if schema_id else {}), dialect.annotation: {"contract": contract_id}}
    schema = canonicalize(raw)
    sha = digest(schema)
    schema = {**schema, dialect.annotation: {**schema[dialect.annotation], "schema_sha256": sha}}
    return Compiled(schema, yaml.safe_dump(schema, sort_keys=True, width=4096, allow_unicode=True), sha)


def named_model(spec: str) -> type:
    """The class that "module:Class" names; its module's code runs."""
    module, _, name = spec.partition(":")
    found = getattr(importlib.import_module(module), name, None) if module and name else None
    if not isinstance(found, type):
        raise ValueError(f"no model at {spec!r}: module:Class is needed")
    return found


def write_schema(compiled: Compiled, path: str) -> None:
    """Write the YAML so that readers see the old file or the new one, never a part."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(compiled.schema_yaml)
        os.replace(part, target)
    except BaseException:
        os.unlink(part)
        raise


def read_schema(path: str) -> dict:
    root = decode(Path(path).read_text(encoding="utf-8"))
    if not isinstance(root, dict):
        raise ValueError(f"schema at {path} is not a mapping at the root")
    return root
