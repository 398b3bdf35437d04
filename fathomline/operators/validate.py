"""Contracts over tables: violations, outcomes and summaries of typed rows or VARIANT columns."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.canonical import canonical_json
from fathomline.plans.columns import VIOLATION, Node, NotColumnar, Program, Row, Typed, Variant, compile_part, compile_schema, json_text, let, recursive_violations
from fathomline.plans.columns import column as named
from fathomline.plans.schema_tree import SchemaTree, load

from .interpret import Evaluator


@dataclass(frozen=True)
class Contract:
    """id: [namespace:]Name[/version]; schema: JSON Schema; status: soft, permissive or enforced; resources: further schemas
    that references may name, by URI."""

    id: str
    schema: dict = field(default_factory=dict)
    status: str = "soft"
    envelope_key: str | None = None
    profile: str = "frontmatter-md"
    schema_ref: str | None = None
    resources: dict[str, dict] = field(default_factory=dict)

    def tree(self) -> SchemaTree:
        return load(self.schema, strict=self.status == "enforced", resources=self.resources)


def program(df: DataFrame, contract: Contract, column: str | None = None) -> Program:
    """The contract compiled for df's rows, or for one of its columns."""
    if column is None:
        node = Row(df.schema)
    else:
        kind = df.schema[column].dataType
        node = Variant(F.col(f"`{column}`")) if isinstance(kind, T.VariantType) else Typed(F.col(f"`{column}`"), kind)
    return compile_schema(contract.tree(), node)


def conditions(df: DataFrame, contract: Contract, column: str | None = None) -> tuple[Column | None, Column]:
    """Whether a row violates the contract, and its violations; None where nothing cheaper says so than the violations.

    A VARIANT is bound once for all checks: its expression, often the parsing of a text, would else stand in each of them."""
    if column is not None and isinstance(df.schema[column].dataType, T.VariantType):
        value, tree = F.col(f"`{column}`"), contract.tree()
        if tree.recursive():
            return None, let(value, lambda v: recursive_violations(tree, v))
        return F.exists(
            F.array(value), lambda v: compile_schema(tree, Variant(v)).invalid(),
        ), let(value, lambda v: compile_schema(tree, Variant(v)).violations())
    compiled = program(df, contract, column)
    return compiled.invalid(), compiled.violations()


def validate_rows(df: DataFrame, contract: Contract, column: str | None = None) -> DataFrame:
    """df with violations (array of structs, sorted by path and keyword); the schema is checked before data is read.

    Runs as Column expressions, recursive schemas too; what Java's patterns can't say, and recursion under a condition, goes to the row interpreter over Arrow batches. In a typed row NULL is a missing property; a NULL VARIANT has no violations."""
    try:
        _, found = conditions(df, contract, column)
    except NotColumnar:
        found = interpreted(as_json(df, column), contract, df.schema if column is None else df.schema[column].dataType)
    return df.withColumn("violations", found)


def violations(df: DataFrame, contract: Contract, keys: list[str], column: str | None = None) -> DataFrame:
    """A row per violation: keys, ordinal (its place in its row's list), json_path (as JSON Pointer), validator, validator_value, value, message.

    Rows without violations are filtered out by a plain predicate before any array is built, so that simple bounds reach
    the scan. The outer explode keeps the optimizer from inferring a filter that would build each array twice."""
    try:
        invalid, found = conditions(df, contract, column)
        listed = df.where(F.lit(True) if invalid is None else invalid).select(*keys, F.posexplode_outer(found))
        if invalid is None:
            listed = listed.where("pos is not null")
    except NotColumnar:
        listed = df.select(*keys, F.posexplode_outer(interpreted(as_json(df, column), contract, df.schema if column is None else df.schema[column].dataType))).where("pos is not null")
    return listed.select(
        *keys, F.col("pos").alias("ordinal"), pointer(F.col("col.json_path")).alias("json_path"), "col.validator", "col.validator_value",
        "col.value", "col.message",
    )


def pointer(parts: Column) -> Column:
    """JSON Pointer of a path."""
    part = lambda c: F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.lit("/"), part(p))))


def item_violations(df: DataFrame, contract: Contract, keys: list[str], column: str) -> DataFrame:
    """The violations of an array column, its items as rows of their own: keys, item (its place, null for the array as a whole),
    json_path, validator, validator_value, value, message.

    Items are dealt out anew, so that one array of millions is checked by many tasks, each item by itself; what is asked of
    the array as a whole (its size, contains, uniqueItems) stays with its row. They are not numbered: (item, json_path,
    validator) is their order. unevaluatedItems and references at the root look at both, and are refused: ValueError."""
    tree, kind = contract.tree(), df.schema[column].dataType
    root = tree.root
    if "unevaluatedItems" in root or "$ref" in root or any(k in root for k in ("allOf", "anyOf", "oneOf", "not", "if")):
        raise ValueError("items can't be checked apart from their array under this schema")
    if not isinstance(kind, (T.ArrayType, T.VariantType)):
        raise ValueError(f"column {column} holds no arrays")
    make = Variant if isinstance(kind, T.VariantType) else (lambda c: Typed(c, kind.elementType))
    value = named(column)
    array = F.try_variant_get(value, "$", "array<variant>") if isinstance(kind, T.VariantType) else value
    first, rest = root.get("prefixItems", []), root.get("items", True)
    own = dataclasses.replace(contract, schema={k: v for k, v in contract.schema.items() if k not in ("items", "prefixItems")})
    whole = violations(df, own, keys, column).drop("ordinal").withColumn("item", F.lit(None).cast("int"))

    items = df.select(*keys, F.posexplode(array).alias("item", "value_")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path, x = F.array(F.col("item").cast("string")), F.col("value_")
    found = None
    for k, sub in enumerate([*first, rest]):
        one = let(x, lambda v: program_of(tree, sub, make(v), path)) if isinstance(kind, T.VariantType) else program_of(tree, sub, make(x), path)
        found = F.when(F.col("item") == k, one) if k < len(first) and found is None else found.when(F.col("item") == k, one) if k < len(first) else one if found is None else found.otherwise(one)
    listed = items.where(x.isNotNull()).select(*keys, "item", F.explode_outer(found).alias("col")).where("col is not null")
    parts = listed.select(*keys, pointer(F.col("col.json_path")).alias("json_path"), "col.validator", "col.validator_value", "col.value", "col.message", "item")
    return whole.unionByName(parts).select(*keys, "item", "json_path", "validator", "validator_value", "value", "message")


def program_of(tree: SchemaTree, schema: Any, node: Node, path: Column) -> Column:
    """Violations of a part of a schema on a node; recursion needs recursive_violations()."""
    return compile_part(tree, schema, node, path).violations()


def as_json(df: DataFrame, column: str | None, texts: bool = False) -> Column:
    """JSON of rows or of a column. A text column is a JSON string, as the Column path has it; with texts it holds JSON itself."""
    if column is None:
        return F.to_json(F.struct(*[named(c).alias(c) for c in df.columns]))
    if isinstance(df.schema[column].dataType, T.StringType):
        return named(column) if texts else json_text(named(column))
    return F.to_json(named(column))


def fractions(kind: T.DataType) -> bool:
    """Whether a type holds doubles or floats."""
    match kind:
        case T.ArrayType():
            return fractions(kind.elementType)
        case T.MapType():
            return fractions(kind.valueType)
        case T.StructType():
            return any(fractions(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def restored(value: Any, kind: T.DataType) -> Any:
    """A JSON value with what JSON has to write as texts, infinities and NaN, as the numbers that they are in a column of that type."""
    match kind:
        case T.DoubleType() | T.FloatType() if isinstance(value, str):
            return float(value)
        case T.ArrayType() if isinstance(value, list) and fractions(kind):
            return [restored(v, kind.elementType) for v in value]
        case T.MapType() if isinstance(value, dict) and fractions(kind):
            return {k: restored(v, kind.valueType) for k, v in value.items()}
        case T.StructType() if isinstance(value, dict) and fractions(kind):
            kinds = {f.name: f.dataType for f in kind.fields}
            return {k: restored(v, kinds[k]) for k, v in value.items()}
    return value


def flat_record(r: dict[str, Any]) -> dict[str, Any]:
    return {
        "json_path": r["path"], "validator": r["validator"],
        "validator_value": canonical_or_json(r["validator_value"]), "value": canonical_or_json(r["value"]),
        "message": r["message"],
    }


def canonical_or_json(value: Any) -> str:
    try:
        return canonical_json(value)
    except TypeError:
        return json.dumps(value, ensure_ascii=False)


ARROW_VIOLATION = pa.struct([("json_path", pa.list_(pa.string())), ("validator", pa.string()), ("validator_value", pa.string()), ("value", pa.string()), ("message", pa.string())])


def interpreted(text: Column, contract: Contract, kind: T.DataType | None = None) -> Column:
    """Violations of JSON texts by the row interpreter; null has none. kind: the type of what the texts were made from."""
    contract.tree()  # schema errors belong here, not into a task

    @F.arrow_udf(T.ArrayType(VIOLATION))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        evaluator = Evaluator(contract.tree())
        read = (lambda t: restored(json.loads(t), kind)) if kind is not None and fractions(kind) else json.loads
        for batch in batches:
            yield pa.array(
                [[flat_record(r) for r in evaluator.violations(read(t.as_py()))] if t.is_valid else [] for t in batch],
                pa.list_(ARROW_VIOLATION),
            )

    return run(text)


def outcomes(df: DataFrame, contract: Contract, keys: list[str], column: str | None = None) -> DataFrame:
    """keys, contract_id, ok, n_violations, first_validator, outcome (valid or invalid)."""
    checked = validate_rows(df, contract, column)
    n = F.size("violations")
    return checked.select(
        *keys, F.lit(contract.id).alias("contract_id"), (n == 0).alias("ok"), n.cast("long").alias("n_violations"),
        F.get("violations", F.lit(0))["validator"].alias("first_validator"),
        F.when(n == 0, "valid").otherwise("invalid").alias("outcome"),
    )


def violations_by_keyword(df: DataFrame, contract: Contract, column: str | None = None) -> DataFrame:
    """contract_id, json_path, validator, violations: counts, combined before the one small shuffle."""
    listed = violations(df, contract, [], column)
    return listed.groupBy("json_path", "validator").agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(contract.id).alias("contract_id"), "json_path", "validator", "violations",
    )
