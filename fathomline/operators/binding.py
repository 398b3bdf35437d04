"""Which contract, payload and schema apply to a decoded document: Column expressions over root_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.vocab import STATUSES, Dialect

#: Fixed value: the grammar of contract ids, [namespace:]Name[/version].
CONTRACT_ID = r"\A(?:[a-z0-9_]+(?:\.[a-z0-9_]+)*:)?[A-Za-z_][A-Za-z0-9_]*(?:/[A-Za-z0-9_.-]+)?\z"
# What results say of faulty bindings.
RELATIVE = "schema must be a relative path: "
ESCAPES = "schema escapes the document directory: "
NOT_FOUND = "compiled schema not found: "
AMBIGUOUS = "multiple top-level frontmatter keys; designate the payload (candidates: "
NOT_MAPPING = ("envelope value is ", ", expected mapping")
META_KEYS = ("contract", "schema", "envelope", "status")


def is_contract_id(c: Column) -> Column:
    return F.coalesce(c.rlike(CONTRACT_ID), F.lit(False))


def short_name(contract_id: Column) -> Column:
    """Name of [namespace:]Name[/version]."""
    return F.split_part(F.element_at(F.split(contract_id, ":"), -1), F.lit("/"), F.lit(1))


def top_keys(root_json: Column) -> Column:
    """Top-level keys in the document's order."""
    return F.coalesce(F.json_object_keys(root_json), F.array().cast("array<string>"))


def members(root_json: Column) -> Column:
    """Top-level members as VARIANT by key."""
    return F.from_json(root_json, "map<string,variant>")


def variant_type(v: Column) -> Column:
    """The Python name of a value's type."""
    k = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(k == "OBJECT", "dict").when(k == "ARRAY", "list").when(k == "STRING", "str").when(k == "BOOLEAN", "bool").when(k == "VOID", "NoneType").when(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int").otherwise("float")


def metadata(docs: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """docs(root_json, ...) with keys, members (VARIANT by key), meta (struct contract, schema, envelope, status, error).

    No block or a null one: meta is null. Text: the contract. A mapping: the four keys, each text and not empty, status
    one of three, no others. error says what is wrong, else null."""
    # each step is a column of its own: the optimizer keeps it as one, where nested expressions would be repeated
    d = docs.withColumn("keys", top_keys(F.col("root_json"))).withColumn("members", members(F.col("root_json")))
    d = d.withColumn("m", F.element_at("members", F.lit(dialect.meta_key))).withColumn("m_kind", variant_type(F.col("m")))
    d = d.withColumn("own", F.when(F.col("m_kind") == "dict", F.try_variant_get("m", "$", "map<string,variant>")))
    d = d.withColumn("types", F.transform_values("own", lambda k, v: variant_type(v)))
    m, kind, own, types = (F.col(c) for c in ("m", "m_kind", "own", "types"))
    text = lambda key: F.when(types[key] == "str", F.try_variant_get(F.element_at(own, F.lit(key)), "$", "string"))
    for key in META_KEYS:
        d = d.withColumn(f"m_{key}", text(key))
    d = d.withColumn("m_contract", F.when(kind == "str", F.try_variant_get(m, "$", "string")).otherwise(F.col("m_contract")))
    d = d.withColumn("unknown", F.array_except(F.map_keys(own), F.array(*map(F.lit, META_KEYS))))
    contract = F.col("m_contract")
    optional = lambda key: (types[key] != "NoneType") & F.coalesce(F.length(f"m_{key}") == 0, F.lit(True))
    error = (
        F.when(~kind.isin("str", "dict"), F.concat(F.lit("metadata must be a string or mapping, got "), kind))
        .when(F.size("unknown") > 0, F.concat(F.lit("unknown metadata keys: "), F.concat_ws(", ", F.sort_array("unknown"))))
        .when(contract.isNull(), F.lit("contract must be a string"))
        .when(~is_contract_id(contract), F.concat(F.lit("malformed contract ID '"), contract, F.lit("'")))
        .when(optional("schema"), F.lit("schema must be a non-empty string"))
        .when(optional("envelope"), F.lit("envelope must be a non-empty string"))
        .when(
            (types["status"] != "NoneType") & ~F.coalesce(F.col("m_status").isin(*STATUSES), F.lit(False)),
            F.lit("status must be soft, permissive or enforced"),
        )
    )
    meta = F.struct(
        contract.alias("contract"), F.col("m_schema").alias("schema"), F.col("m_envelope").alias("envelope"),
        F.col("m_status").alias("status"), error.alias("error"),
    )
    return d.withColumn("meta", F.when(m.isNotNull() & (kind != "NoneType"), meta)).drop(
        "m", "m_kind", "own", "types", "unknown", *[f"m_{k}" for k in META_KEYS],
    )


def envelope(docs: DataFrame, host_key: Column, contract_id: Column, profile: Column, dialect: Dialect = Dialect()) -> DataFrame:
    """docs(keys, members, meta) with payload_json and envelope_error(kind, message, expected_key, actual_keys).

    The key: the host's, else the document's, else, for frontmatter, the only other one; pure YAML without a key is its
    whole root but for the metadata."""
    yaml = profile == "pure-yaml"
    d = docs.withColumn("mine", F.filter("keys", lambda k: k != dialect.meta_key)).withColumn("declared", F.coalesce(host_key, F.col("meta.envelope")))
    mine, declared = F.col("mine"), F.col("declared")
    d = d.withColumn("envelope_key", F.coalesce(declared, F.when(~yaml & (F.size(mine) == 1), F.get(mine, F.lit(0)))))
    key = F.col("envelope_key")
    d = d.withColumn(
        "value", F.when(F.array_contains("keys", key), F.element_at("members", key)),
    ).withColumn("value_type", variant_type(F.col("value")))
    kind = (
        F.when(declared.isNotNull() & ~F.array_contains("keys", declared), "envelope_mismatch")
        .when(declared.isNull() & ~yaml & (F.size(mine) > 1), "envelope_ambiguous")
        .when(declared.isNull() & ~yaml & (F.size(mine) == 0), "envelope_missing")
        .when(key.isNotNull() & (F.col("value_type") != "dict"), "envelope_not_mapping")
    )
    d = d.withColumn("fault", kind)
    fault = F.col("fault")
    message = (
        F.when(fault == "envelope_mismatch", F.concat(F.lit("contract '"), contract_id, F.lit("' expects '"), declared, F.lit("'")))
        .when(
            fault == "envelope_ambiguous",
            F.concat(F.lit(AMBIGUOUS), F.concat_ws(", ", mine), F.lit(")")),
        )
        .when(fault == "envelope_missing", F.lit("document has no payload key beside its metadata"))
        .when(fault == "envelope_not_mapping", F.concat(F.lit(NOT_MAPPING[0]), F.col("value_type"), F.lit(NOT_MAPPING[1])))
    )
    mismatch = fault == "envelope_mismatch"
    error = F.struct(
        fault.alias("kind"), message.alias("message"), F.when(mismatch, declared).alias("expected_key"),
        F.when(mismatch, mine).alias("actual_keys"),
    )
    whole = F.to_json(F.map_filter("members", lambda k, v: k != dialect.meta_key))
    d = d.withColumn("envelope_error", F.when(fault.isNotNull(), error)).withColumn(
        "payload_json", F.when(fault.isNull(), F.when(key.isNotNull(), F.to_json("value")).otherwise(whole)),
    )
    return d.drop("mine", "declared", "value", "value_type", "fault", "members")


def schema_source(host_ref: Column, document_ref: Column, has_model: Column) -> Column:
    """host, document, model or none: whose schema binding counts."""
    return F.when(host_ref.isNotNull(), "host").when(document_ref.isNotNull(), "document").when(has_model, "model").otherwise("none")


def normal_path(path: str) -> str:
    """A path without scheme file:, empty parts, "." and "x/.."; a leading slash and leading ".." stay."""
    out: list[str] = []
    bare = path[5:] if path.startswith("file:") else path
    for part in bare.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/" * bare.startswith("/") + "/".join(out)


def normal(path: Column) -> Column:
    """normal_path() of a column."""
    bare = F.regexp_replace(path, "^file:", "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    start = F.array().cast("array<string>")
    step = lambda a, p: F.when(
        (p == "..") & (F.size(a) > 0) & F.coalesce(last(a) != "..", F.lit(True)),
        F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
    ).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    return F.concat(F.when(bare.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(F.split(bare, "/"), start, step), "/"))


def document_schema_error(ref: Column, known: Column) -> Column:
    """Why a document's own schema reference is refused: absolute, leaving its folder, or not in the catalogue; else null.

    An object store has no symlinks to resolve: the path is followed by its parts."""
    return (
        F.when(ref.startswith("/"), F.concat(F.lit(RELATIVE), ref))
        .when(normal(ref).rlike(r"^\.\.(/|$)"), F.concat(F.lit(ESCAPES), ref))
        .when(~known, F.concat(F.lit(NOT_FOUND), ref))
    )


def registry_conflicts(contracts: DataFrame) -> DataFrame:
    """Ids that are registered with different definitions."""
    rest = [c for c in contracts.columns if c != "id"]
    return contracts.groupBy("id").agg(F.countDistinct(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("definitions")).where("definitions > 1")
