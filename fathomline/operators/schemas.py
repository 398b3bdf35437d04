"""Schemas as a table: checked, navigated and compared where their rows are.

A catalogue has a row per schema: schema_ref (a path or name) and schema_text (JSON or YAML). Schemas meet documents by
joins on these, so a plan is the same for one schema and for a million. What a text compiles to is kept by its content in
each Python worker, as long as it is among those used last.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.canonical import canonical_json
from fathomline.plans.schema_tree import EnforcementUnsupported, SchemaInvalid, canonicalize, load
from fathomline.sources.yaml12 import Rejected, decode

from .interpret import Evaluator

#: How many compiled schemas a worker keeps.
KEPT = 256


class Kept:
    """Results of make(key) by key, the `size` used last; made: how often something was made."""

    def __init__(self, size: int = KEPT) -> None:
        self.size, self.made = size, 0
        self.by_key: OrderedDict[Any, Any] = OrderedDict()

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        if key in self.by_key:
            self.by_key.move_to_end(key)
            return self.by_key[key]
        self.made += 1
        found = self.by_key[key] = make()
        if len(self.by_key) > self.size:
            self.by_key.popitem(last=False)
        return found


#: One for each Python worker, which serves many tasks.
COMPILED = Kept()


def parsed(text: str | None) -> Any:
    """The schema that a text holds; SchemaInvalid for the reason syntax if it holds none."""
    if text is None:
        raise SchemaInvalid("syntax", "schema is no UTF-8 text")
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        return decode(text)
    except Rejected as e:
        raise SchemaInvalid("syntax", f"schema is neither JSON nor YAML: {e}") from e


def content_key(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def compiled(text: str | None, strict: bool, resources: dict[str, dict] | None = None, kept: Kept | None = None) -> Evaluator | dict[str, Any]:
    """An Evaluator, or the error record of a schema that can't be used; failures are kept too.

    The same text, strictness and resources are compiled once as long as `kept` (COMPILED) holds them."""

    def make() -> Evaluator | dict[str, Any]:
        try:
            return Evaluator(load(parsed(text), strict, resources))
        except SchemaInvalid as e:
            return {"kind": "schema_invalid", "message": str(e), "reason": e.reason}
        except EnforcementUnsupported as e:
            return {"kind": "enforcement_unsupported", "message": str(e), "reason": None}

    others = content_key(json.dumps(resources, sort_keys=True)) if resources else None
    return (COMPILED if kept is None else kept).get((content_key(text), strict, others), make)


def catalogue(spark: SparkSession, schemas: dict[str, Any] | DataFrame | None) -> DataFrame:
    """schema_ref, schema_text: of a table that has them, or of schemas by reference that the driver holds."""
    if isinstance(schemas, DataFrame):
        return schemas.select("schema_ref", "schema_text")
    rows = [(ref, s if isinstance(s, str) else json.dumps(s, ensure_ascii=False)) for ref, s in (schemas or {}).items()]
    return spark.createDataFrame(rows, "schema_ref string, schema_text string")


def schema_files(files: DataFrame, below: str = "") -> DataFrame:
    """A catalogue of files (path, content), named by their paths without the prefix `below`; what is no UTF-8 has no text."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    name = F.when(F.col("path").startswith(below), F.substring("path", len(below) + 1, 1 << 20)).otherwise(F.col("path"))
    return files.select(name.alias("schema_ref"), text.alias("schema_text"))


def mapped(schemas: DataFrame, make: Callable[[str, str], Iterable[tuple]], kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """schema_ref and further columns of the rows that make(ref, text) gives for each schema; kinds: Spark's and Arrow's type of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(ref, *row) for ref, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in make(ref, text)]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), *(k for _, k in kinds.values())))], ["schema_ref", *kinds])

    return schemas.select("schema_ref", "schema_text").mapInArrow(run, ", ".join(["schema_ref string", *(f"{c} {k}" for c, (k, _) in kinds.items())]))


TEXT, FLAG = ("string", pa.string()), ("boolean", pa.bool_())


def load_errors(schemas: DataFrame, resources: dict[str, dict] | None = None) -> DataFrame:
    """schema_ref, strict, load_kind, load_reason, load_message: which schemas can be used, a row without and one with the enforced overlay."""

    def make(ref: str, text: str) -> Iterator[tuple]:
        for strict in (False, True):
            use = compiled(text, strict, resources)
            yield (strict, use["kind"], use["reason"], use["message"]) if isinstance(use, dict) else (strict, None, None, None)

    return mapped(schemas, make, {"strict": FLAG, "load_kind": TEXT, "load_reason": TEXT, "load_message": TEXT})


def canonical_forms(schemas: DataFrame) -> DataFrame:
    """schema_ref, canonical (JSON of the schema's stable form), schema_sha256 of it; null for what is no schema."""

    def make(ref: str, text: str) -> Iterator[tuple]:
        try:
            yield (canonical_json(canonicalize(parsed(text))),)
        except (SchemaInvalid, TypeError):
            yield (None,)

    done = mapped(schemas, make, {"canonical": TEXT})
    return done.withColumn("schema_sha256", F.sha2(F.col("canonical").cast("binary"), 256))


def contents(schemas: DataFrame) -> DataFrame:
    """schema_ref, content (canonical JSON of the schema as it is, so formatting, key order and 1.0 for 1 don't count)."""

    def make(ref: str, text: str) -> Iterator[tuple]:
        try:
            yield (canonical_json(parsed(text)),)
        except (SchemaInvalid, TypeError):
            yield (None,)

    return mapped(schemas, make, {"content": TEXT})


#: What is said of a schema that has drifted.
MISSING, DIFFERS = "missing committed compiled schema at {ref}", "committed schema at {ref} differs from compile output"


def schema_drift(committed: DataFrame, made: DataFrame) -> DataFrame:
    """schema_ref, drift, drift_diff (what is wrong, null without drift): by content; one that is missing, or no schema, on a side is drift."""
    old, new = contents(committed).withColumn("there", F.lit(True)), contents(made).withColumnRenamed("content", "other")
    both = old.join(new, "schema_ref", "full").withColumn("drift", ~F.coalesce(F.col("content") == F.col("other"), F.lit(False)))
    said = lambda text: F.concat(F.lit(text.partition("{ref}")[0]), F.col("schema_ref"), F.lit(text.partition("{ref}")[2]))
    return both.select("schema_ref", "drift", F.when(F.col("drift"), F.when(F.col("there").isNull(), said(MISSING)).otherwise(said(DIFFERS))).alias("drift_diff"))


def located(docs: DataFrame, schemas: DataFrame, ref: Column, path: Column, source: Column) -> DataFrame:
    """docs with schema_ref, schema_text of the schema that a reference names, null where there is none.

    Two paths lead to a schema: below the working folder and below the document's folder. A host's reference is looked
    for in that order, a document's in the other; a host's absolute one only as it is. Each is a left equi-join with the catalogue by its
    normal paths, of which the first by schema_ref counts where several references are the same path."""
    from .binding import normal

    known = schemas.select(normal(F.col("schema_ref")).alias("at_"), F.struct("schema_ref", "schema_text").alias("found_"))
    known = known.groupBy("at_").agg(F.min_by("found_", "found_.schema_ref").alias("found_"))
    beside = normal(F.concat(F.regexp_replace(path, "[^/]*$", ""), ref))
    asked = source.isin("host", "document")
    d = docs.withColumns({
        "here_": F.when(asked, normal(ref)),
        "beside_": F.when(asked & ~((source == "host") & ref.startswith("/")), beside),
        "own_": source == "document",
    })
    d = d.join(known.select(F.col("at_").alias("here_"), F.col("found_").alias("here_found_")), "here_", "left")
    d = d.join(known.select(F.col("at_").alias("beside_"), F.col("found_").alias("beside_found_")), "beside_", "left")
    found = F.when(F.col("own_"), F.coalesce("beside_found_", "here_found_")).otherwise(F.coalesce("here_found_", "beside_found_"))
    d = d.withColumn("found_", found)
    return d.withColumns({"schema_ref": F.col("found_.schema_ref"), "schema_text": F.col("found_.schema_text")}).drop("here_", "beside_", "own_", "here_found_", "beside_found_", "found_")
