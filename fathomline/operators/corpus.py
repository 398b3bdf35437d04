"""Corpora: decoded documents bound to contracts and checked, structurally and by models; everything stays a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.vocab import Dialect

from . import binding
from .schemas import catalogue, compiled, located
from .validate import Contract, canonical_or_json

ERROR = "struct<kind:string,path:array<string>,validator:string,validator_value:string,value:string,message:string,reason:string,expected_key:string,actual_keys:array<string>>"
_ARROW_ERROR = pa.struct([("kind", pa.string()), ("path", pa.list_(pa.string())), ("validator", pa.string()), ("validator_value", pa.string()), ("value", pa.string()), ("message", pa.string()), ("reason", pa.string()), ("expected_key", pa.string()), ("actual_keys", pa.list_(pa.string()))])


def payload_of(root_json: str, key: str | None, meta_key: str) -> Any:
    root = json.loads(root_json)
    return root.get(key) if key is not None else {k: v for k, v in root.items() if k != meta_key}


def validate_corpus(
    docs: DataFrame,
    contracts: list[Contract],
    schemas: dict[str, Any] | DataFrame,
    contract_col: str | None = None,
    profile: str = "frontmatter-md",
    models: dict[str, type] | None = None,
    metadata_mode: str = "enforced",
    dialect: Dialect = Dialect(),
    resources: dict[str, dict] | None = None,
    infer: bool = False,
    status: str | None = None,
    host_schema: str | None = None,
    host_envelope: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Results of decoded documents (path, has_frontmatter, root_json, root_type, kind, message).

    The contract is contract_col's, else the one the document names. Host settings win over the document's: envelope,
    schema and status; host_schema and host_envelope hold where the contract's registration has none. With infer a contract needs no registration, and the status is the one given, else the document's,
    else soft. schemas: by reference, or a catalogue (operators/schemas.py) of any size. resources: schemas that references may name beside their own. Schemas are named by path: a host's is looked
    for as given, in the working folder and in the document's folder. Returns path, contract_id, status, outcome, ok, structural_ok, structural_skipped, errors,
    semantic_ok, semantic_skipped, semantic_errors (JSON), warnings, warning_codes, envelope_key, schema_source, payload_json.
    carry: columns of docs that come along. Contracts and resources are the driver's. A schema's text comes with the documents that it checks and is compiled once a worker."""
    spark = docs.sparkSession
    models = models or {}
    registry = spark.createDataFrame(
        [(c.id, c.envelope_key, c.status, c.schema_ref, c.id in models) for c in contracts] or [], "reg_id string, reg_envelope string, reg_status string, reg_schema string, reg_model boolean"
    )
    d = binding.metadata(docs, dialect)
    d = d.withColumn("contract_id", F.coalesce(F.col(contract_col) if contract_col else F.lit(None).cast("string"), F.col("meta.contract")))
    d = d.join(registry, F.col("contract_id") == F.col("reg_id"), "left")
    d = d.withColumn("reg_envelope", F.coalesce("reg_envelope", F.lit(host_envelope).cast("string"))).withColumn("reg_schema", F.coalesce("reg_schema", F.lit(host_schema).cast("string")))
    d = binding.envelope(d, F.col("reg_envelope"), F.col("contract_id"), F.lit(profile), dialect)
    known = F.col("reg_id").isNotNull() | (F.lit(infer) & F.col("contract_id").isNotNull())
    declared = F.when(F.col("meta.error").isNull(), F.col("meta.status"))
    chosen = F.coalesce(F.lit(status).cast("string"), declared if infer else F.col("reg_status"), F.lit("soft"))
    d = d.withColumn("status_", chosen).withColumn("known_", known)
    known, status = F.col("known_"), F.col("status_")
    differs = F.col("meta.contract").isNotNull() & (F.col("meta.contract") != F.col("contract_id"))
    said = F.concat(F.lit("document declares '"), F.col("meta.contract"), F.lit("'; contract uses '"), F.col("contract_id"), F.lit("'"))
    failure = (
        F.when(F.col("contract_id").isNotNull() & ~known & F.col("meta.error").isNull(), "contract_unknown")
        .when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.lit(profile == "frontmatter-md") & ~F.col("has_frontmatter"), "no_frontmatter")
        .when(F.lit(profile == "pure-yaml") & (F.col("root_type") != "dict"), "yaml_not_mapping")
        .when(F.col("meta.error").isNotNull(), "document_metadata_invalid")
        .when(~known, "contract_unknown")
        .when(differs & F.lit(metadata_mode == "enforced"), "document_contract_mismatch")
        .when(F.col("envelope_error").isNotNull(), F.col("envelope_error.kind"))
    )
    d = d.withColumn("failure", failure)
    failure = F.col("failure")
    text = (
        F.when(
            failure == "contract_unknown",
            F.concat(F.lit("no contract registered for '"), F.coalesce("contract_id", F.lit("<unknown>")), F.lit("'")),
        )
        .when(failure == F.col("kind"), F.col("message"))
        .when(failure == "no_frontmatter", F.concat(F.lit("no frontmatter in "), F.col("path").cast("string")))
        .when(failure == "yaml_not_mapping", F.concat(F.lit("YAML root is "), F.col("root_type"), F.lit(", expected mapping")))
        .when(failure == "document_metadata_invalid", F.col("meta.error"))
        .when(failure == "document_contract_mismatch", said)
        .otherwise(F.col("envelope_error.message"))
    )
    source = binding.schema_source(F.col("reg_schema"), F.col("meta.schema"), F.coalesce("reg_model", F.lit(False)))
    ref, path = F.coalesce("reg_schema", "meta.schema"), F.col("path").cast("string")
    d = d.withColumn("failure_message", text).withColumn("schema_source", source).withColumn("schema_named", ref)
    d = located(d, catalogue(spark, schemas), F.col("schema_named"), path, F.col("schema_source"))
    ref, source, in_catalogue = F.col("schema_named"), F.col("schema_source"), F.col("schema_ref").isNotNull()
    missing = F.when(
        source == "host", F.when(~in_catalogue, F.concat(F.lit(binding.NOT_FOUND), ref)),
    ).when(source == "document", binding.document_schema_error(ref, in_catalogue))
    d = d.withColumn("schema_error", F.when(failure.isNull(), missing))
    meta_key = dialect.meta_key

    @F.arrow_udf(f"array<{ERROR}>")
    def structural(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for roots, keys, texts, strict in batches:
            out = []
            for root, key, text, s in zip(roots.to_pylist(), keys.to_pylist(), texts.to_pylist(), strict.to_pylist(), strict=True):
                if root is None:
                    out.append([])
                elif isinstance(use := compiled(text, s, resources), dict):
                    out.append([use])
                else:
                    out.append([r | {"validator_value": canonical_or_json(r["validator_value"]), "value": canonical_or_json(r["value"])} for r in use.violations(payload_of(root, key, meta_key))])
            yield pa.array(out, pa.list_(_ARROW_ERROR))

    @F.arrow_udf("array<string>")
    def semantic(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from pydantic import ValidationError

        for roots, keys, ids in batches:
            out = []
            for root, key, name in zip(roots.to_pylist(), keys.to_pylist(), ids.to_pylist(), strict=True):
                model, found = models.get(name) if root is not None else None, []
                if model is not None:
                    try:
                        model.model_validate(payload_of(root, key, meta_key))
                    except ValidationError as e:
                        found = [json.dumps(x, default=str, ensure_ascii=False) for x in e.errors(include_url=False)]
                out.append(found)
            yield pa.array(out, pa.list_(pa.string()))

    fine = F.col("failure").isNull()
    usable = fine & F.col("schema_error").isNull() & F.col("schema_source").isin("host", "document")
    d = d.withColumn("checked", structural(F.when(usable, F.col("root_json")), F.col("envelope_key"), F.col("schema_text"), status == "enforced"))
    if models:
        d = d.withColumn("semantic_errors", semantic(F.when(fine, F.col("root_json")), F.col("envelope_key"), F.col("contract_id")))
    else:
        d = d.withColumn("semantic_errors", F.array().cast("array<string>"))
    null = lambda t: F.lit(None).cast(t)
    lone = lambda kind, message, key=None, keys=None: F.array(F.struct(
        kind.alias("kind"), null("array<string>").alias("path"), null("string").alias("validator"), null("string").alias("validator_value"), null("string").alias("value"), message.alias("message"), null("string").alias("reason"),
        (null("string") if key is None else key).alias("expected_key"), (null("array<string>") if keys is None else keys).alias("actual_keys"),
    )).cast(f"array<{ERROR}>")
    errors = F.when(
        ~fine,
        lone(F.col("failure"), F.col("failure_message"), F.col("envelope_error.expected_key"), F.col("envelope_error.actual_keys")),
    ).when(F.col("schema_error").isNotNull(), lone(F.lit("schema_missing"), F.col("schema_error"))).otherwise(F.col("checked"))
    skipped = F.when(fine & (F.col("schema_source") == "model"), "inferred_via_model").when(fine & (F.col("schema_source") == "none"), "no_schema")
    model_here = F.coalesce("reg_model", F.lit(False))
    warn = lambda code, m: F.struct(F.lit(code).alias("code"), m.alias("message"), F.lit("warning").alias("severity"))
    other_status = F.col("meta.status").isNotNull() & (F.col("meta.status") != status)
    status_said = F.concat(F.lit("document declares status '"), F.col("meta.status"), F.lit("'; contract uses '"), status, F.lit("'"))
    reached = known & F.col("kind").isNull() & F.col("meta.error").isNull()
    warnings = F.array_compact(F.array(
        F.when(reached & differs & F.lit(metadata_mode == "advisory"), warn("document-contract-mismatch", said)),
        F.when(reached & other_status & ~(differs & F.lit(metadata_mode == "enforced")), warn("document-status-mismatch", status_said)),
    ))
    d = d.withColumn("errors", errors).withColumn("status", status)
    structural_ok = F.size("errors") == 0
    semantic_ok = fine & (F.size("semantic_errors") == 0)
    first = F.get("errors", F.lit(0))["kind"]
    ok = structural_ok & semantic_ok
    return d.select(
        "path", F.coalesce("contract_id", F.lit("<unknown>")).alias("contract_id"), "status", F.when(ok, "valid").when(
            first.isin("artifact_unreadable", "artifact_invalid_utf8"), "input_error",
        ).otherwise("invalid").alias("outcome"),
        ok.alias("ok"), structural_ok.alias("structural_ok"), skipped.alias("structural_skipped"), "errors", semantic_ok.alias("semantic_ok"), F.when(~fine, F.col("failure")).when(~model_here, F.lit("no_semantic_model")).alias("semantic_skipped"),
        "semantic_errors", warnings.alias("warnings"), F.transform(warnings, lambda w: w["code"]).alias("warning_codes"), "envelope_key", "schema_source", F.when(fine, F.col("payload_json")).alias("payload_json"),
        *carry,
    )


def error_rows(results: DataFrame) -> DataFrame:
    """A row per error: path, ordinal, json_path (as JSON Pointer) and the error's other columns."""
    listed = results.select("path", F.posexplode_outer("errors")).where("pos is not null")
    part = lambda c: F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    pointer = F.concat_ws("", F.transform(F.col("col.path"), lambda p: F.concat(F.lit("/"), part(p))))
    rest = ("kind", "validator", "validator_value", "value", "message", "reason", "expected_key", "actual_keys")
    return listed.select(
        "path", F.col("pos").alias("ordinal"), F.when(F.col("col.path").isNotNull(), pointer).alias("json_path"),
        *[F.col(f"col.{c}") for c in rest],
    )


def warning_rows(results: DataFrame) -> DataFrame:
    return results.select("path", F.explode_outer("warnings").alias("w")).where("w is not null").select("path", "w.*")


def inspect_corpus(docs: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """path, has_frontmatter, meta, envelope_keys (in the document's order)."""
    d = binding.metadata(docs, dialect)
    return d.select("path", "has_frontmatter", "meta", F.filter("keys", lambda k: k != dialect.meta_key).alias("envelope_keys"))
