"""Registered queries over the shared tables, each with its SQL where SQL can express it.

Arrays and structs come out as JSON text, so that any engine can compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import binding, sections
from fathomline.operators.corpus import error_rows, inspect_corpus, validate_corpus, warning_rows
from fathomline.operators.validate import Contract, outcomes, validate_rows, violations, violations_by_keyword
from fathomline.sources.documents import decode_table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- tables -------------------------------------------------------------------------------------------------------

ORDERS = Contract(
    "shop:Orders/v1",
    {"type": "object", "properties": {"o_orderstatus": {"enum": ["F", "O"]}, "o_totalprice": {"type": "number", "maximum": 400000}, "o_orderpriority": {"type": "string", "pattern": "^[1-3]-"}}, "required": ["o_orderkey"]},
)
ORDERS_SQL = """
SELECT o_orderkey, '/o_orderstatus' AS json_path, 'enum' AS validator, 'value ''' || o_orderstatus || ''' is not one of [''F'', ''O'']' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, '/o_orderpriority', 'pattern', 'value ''' || o_orderpriority || ''' does not match pattern ''^[1-3]-''' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
UNION ALL SELECT o_orderkey, '/o_totalprice', 'maximum', 'value ' || CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT)::VARCHAR ELSE o_totalprice::VARCHAR END || ' is greater than the maximum of 400000' FROM orders WHERE o_totalprice > 400000
"""


@query("orders_violations", ORDERS_SQL)
def orders_violations(spark, d):
    return violations(read(spark, d, "orders"), ORDERS, ["o_orderkey"]).select("o_orderkey", "json_path", "validator", "message")


@query("violations_by_keyword", f"SELECT 'shop:Orders/v1' AS contract_id, json_path, validator, count(*)::BIGINT AS violations FROM ({ORDERS_SQL}) GROUP BY json_path, validator")
def by_keyword(spark, d):
    return violations_by_keyword(read(spark, d, "orders"), ORDERS)


@query("first_violation", f"SELECT o_orderkey, json_path, validator FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY json_path, validator) AS n FROM ({ORDERS_SQL})) WHERE n = 1")
def first_violation(spark, d):
    first = F.get("violations", F.lit(0))
    checked = validate_rows(read(spark, d, "orders"), ORDERS).where(F.size("violations") > 0)
    return checked.select(
        "o_orderkey", F.concat(F.lit("/"), F.concat_ws("/", first["json_path"])).alias("json_path"),
        first["validator"].alias("validator"),
    )


@query("outcome_by_contract", """
SELECT contract_id, outcome, count(*)::BIGINT AS n_rows FROM (
  SELECT 'shop:Orders/v1' AS contract_id, CASE WHEN o_orderstatus IN ('F', 'O') AND o_totalprice <= 400000 AND regexp_matches(o_orderpriority, '^[1-3]-') THEN 'valid' ELSE 'invalid' END AS outcome FROM orders
  UNION ALL SELECT 'shop:Customer/v1', CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' THEN 'valid' ELSE 'invalid' END FROM customer) GROUP BY 1, 2
""")
def outcome_by_contract(spark, d):
    customer = Contract("shop:Customer/v1", {"properties": {"c_acctbal": {"minimum": 0}, "c_mktsegment": {"not": {"const": "BUILDING"}}}})
    a = outcomes(read(spark, d, "orders"), ORDERS, ["o_orderkey"]).select("contract_id", "outcome")
    b = outcomes(read(spark, d, "customer"), customer, ["c_custkey"]).select("contract_id", "outcome")
    return a.union(b).groupBy("contract_id", "outcome").agg(F.count(F.lit(1)).alias("n_rows"))


LINE = {"properties": {"l_quantity": {"minimum": 5, "exclusiveMaximum": 50}, "l_discount": {"exclusiveMinimum": 0, "maximum": 0.09}}}


@query("lineitem_bounds", """
SELECT validator, json_path, count(*)::BIGINT AS n FROM (
  SELECT 'minimum' AS validator, '/l_quantity' AS json_path FROM lineitem WHERE l_quantity < 5
  UNION ALL SELECT 'exclusiveMaximum', '/l_quantity' FROM lineitem WHERE l_quantity >= 50
  UNION ALL SELECT 'exclusiveMinimum', '/l_discount' FROM lineitem WHERE l_discount <= 0
  UNION ALL SELECT 'maximum', '/l_discount' FROM lineitem WHERE l_discount > 0.09::DOUBLE) GROUP BY ALL
""")
def lineitem_bounds(spark, d):
    return violations_by_keyword(read(spark, d, "lineitem"), Contract("shop:Line/v1", LINE)).select("validator", "json_path", F.col("violations").alias("n"))


@query("lineitem_multiple_of", """
SELECT l_orderkey, l_linenumber, 'value ' || CAST(l_quantity AS BIGINT) || ' is not a multiple of 5' AS message FROM lineitem WHERE l_quantity % 5 <> 0
""")
def lineitem_multiple_of(spark, d):
    c = Contract("shop:Line/v2", {"properties": {"l_quantity": {"multipleOf": 5}}})
    return violations(read(spark, d, "lineitem"), c, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "message")


@query("part_length_pattern", """
SELECT p_partkey, 'minLength' AS validator FROM part WHERE length(p_name) < 8
UNION ALL SELECT p_partkey, 'maxLength' FROM part WHERE length(p_type) > 6
UNION ALL SELECT p_partkey, 'pattern' FROM part WHERE NOT regexp_matches(p_brand, '[1-3]$')
""")
def part_length_pattern(spark, d):
    c = Contract("shop:Part/v1", {"properties": {"p_name": {"minLength": 8}, "p_type": {"maxLength": 6}, "p_brand": {"pattern": "[1-3]$"}}})
    return violations(read(spark, d, "part"), c, ["p_partkey"]).select("p_partkey", "validator")


@query("embedding_items", """
SELECT vec_id, count(*)::BIGINT AS n FROM (
  SELECT vec_id FROM embeddings WHERE len(embedding) > 63
  UNION ALL SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.3::DOUBLE) GROUP BY vec_id
""")
def embedding_items(spark, d):
    c = Contract(
        "ml:Vector/v1",
        {"properties": {"embedding": {"type": "array", "minItems": 1, "maxItems": 63, "items": {"type": "number", "maximum": 0.3}}}},
    )
    return violations(read(spark, d, "embeddings"), c, ["vec_id"]).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


@query("label_required_null", "SELECT d.doc_id, '[\"quality\"]' AS validator_value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def label_required_null(spark, d):
    joined = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return violations(joined, Contract("ml:Label/v1", {"required": ["quality"]}), ["doc_id"]).select("doc_id", "validator_value")


def event_props(spark, d):
    return read(spark, d, "events").select("event_id", F.parse_json("props").alias("props"))


@query("event_props_valid", """
SELECT event_id, 'value ' || json_extract_string(props, '$.k') || ' is greater than the maximum of 50' AS message FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50
""")
def event_props_valid(spark, d):
    c = Contract("web:Props/v1", {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}, "required": ["k"]})
    return violations(event_props(spark, d), c, ["event_id"], "props").select("event_id", "message")


OPEN = {"type": "object", "properties": {"z": {"type": "string"}}}


@query("event_props_enforced", "SELECT event_id, '' AS json_path, 'additionalProperties' AS validator, props AS value FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)")
def event_props_enforced(spark, d):
    return violations(
        event_props(spark, d), Contract("web:Props/v2", OPEN, status="enforced"), ["event_id"], "props",
    ).select("event_id", "json_path", "validator", "value")


@query("event_props_permissive", "SELECT 'permissive' AS status, 0::BIGINT AS n_violations, count(*)::BIGINT AS n_rows FROM events")
def event_props_permissive(spark, d):
    found = outcomes(event_props(spark, d), Contract("web:Props/v2", OPEN, status="permissive"), ["event_id"], "props")
    return found.agg(F.lit("permissive").alias("status"), F.sum("n_violations").alias("n_violations"), F.count(F.lit(1)).alias("n_rows"))


@query("conversation_any_of", """
SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'anyOf' END AS any_of, CASE WHEN (role = 'user')::INT + (length(text) > 60)::INT <> 1 THEN 'oneOf' END AS one_of, CASE WHEN role = 'system' THEN 'not' END AS not_
FROM conversations WHERE role NOT IN ('user', 'assistant') OR (role = 'user')::INT + (length(text) > 60)::INT <> 1
""")
def conversation_any_of(spark, d):
    c = Contract("chat:Turn/v1", {
        "properties": {"role": {"anyOf": [{"const": "user"}, {"const": "assistant"}], "not": {"const": "system"}}},
        "oneOf": [{"properties": {"role": {"const": "user"}}}, {"properties": {"text": {"minLength": 61}}}],
    })
    by = violations(read(spark, d, "conversations"), c, ["conv_id", "turn"])
    pick = lambda k: F.max(F.when(F.col("validator") == k, k))
    return by.groupBy("conv_id", "turn").agg(pick("anyOf").alias("any_of"), pick("oneOf").alias("one_of"), pick("not").alias("not_"))


@query("unique_items", """
WITH g AS (SELECT l_orderkey, list(l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'uniqueItems' AS validator FROM g WHERE len(list_distinct(flags)) < len(flags) UNION ALL SELECT l_orderkey, 'contains' FROM g WHERE NOT list_contains(flags, 'N')
""")
def unique_items(spark, d):
    flags = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    c = Contract("shop:Flags/v1", {"properties": {"flags": {"uniqueItems": True, "contains": {"const": "N"}}}})
    return violations(flags, c, ["l_orderkey"]).select("l_orderkey", "validator")


@query("map_additional", """
SELECT event_id, 'maximum' AS validator, '/k' AS json_path FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 90
""")
def map_additional(spark, d):
    typed = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("props"))
    c = Contract("web:Counts/v1", {"properties": {"props": {"type": "object", "additionalProperties": {"type": "integer", "maximum": 90}}}})
    return violations(typed, c, ["event_id"]).select("event_id", "validator", F.replace("json_path", F.lit("/props"), F.lit("")).alias("json_path"))


@query("conditional_required", """
SELECT s_suppkey, 'maximum' AS validator FROM supplier WHERE s_nationkey < 5 AND s_acctbal > 5000 UNION ALL SELECT s_suppkey, 'minimum' FROM supplier WHERE NOT s_nationkey < 5 AND s_acctbal < 0
""")
def conditional(spark, d):
    c = Contract(
        "shop:Supplier/v1",
        {"if": {"properties": {"s_nationkey": {"exclusiveMaximum": 5}}}, "then": {"properties": {"s_acctbal": {"maximum": 5000}}}, "else": {"properties": {"s_acctbal": {"minimum": 0}}}},
    )
    return violations(read(spark, d, "supplier"), c, ["s_suppkey"]).select("s_suppkey", "validator")


@query("recursive_interpreted", "SELECT event_id, '/k' AS json_path, 'value ' || json_extract_string(props, '$.k') || ' is less than the minimum of 10' AS message FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) < 10")
def recursive_interpreted(spark, d):
    c = Contract(
        "web:Tree/v1",
        {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10}, "child": {"$ref": "#/$defs/node"}}}}},
    )
    return violations(event_props(spark, d), c, ["event_id"], "props").select("event_id", "json_path", "message")


# ---- documents made from columns ----------------------------------------------------------------------------------

DOC = {
    "type": "object",
    "properties": {"id": {"type": "integer", "maximum": 500}, "lang": {"enum": ["en", "de"]}, "note": {"type": "string"}},
    "required": ["id", "lang"],
}
DOC_CONTRACT = Contract("corpus:Doc/v1", DOC, schema_ref="doc.schema.yaml")
SCHEMAS = {"doc.schema.yaml": DOC}


def artifacts(spark, d, text) -> DataFrame:
    """path and text of a document for each row of documents."""
    return read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), text.alias("text"))


def lines(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])



def good(id_="doc_id"):
    return lines(
        "---\nfathom: corpus:Doc/v1\ndoc:\n  id: ", F.col(id_), "\n  lang: ", F.col("lang"),
        "\n  day: 2026-07-11\n---\nbody of ", F.col("doc_id"),
    )


@query("synth_frontmatter_roundtrip", "SELECT 'doc/' || doc_id AS path, doc_id::VARCHAR AS id, lang, '2026-07-11' AS day, 'body of ' || doc_id AS body FROM documents")
def roundtrip(spark, d):
    got = decode_table(artifacts(spark, d, good()), "text")
    pick = lambda k: F.get_json_object("root_json", f"$.doc.{k}").alias(k)
    return got.select("path", pick("id"), pick("lang"), pick("day"), "body")


#: A defect for each remainder of doc_id, and the kind it is found as (null: none).
DEFECTS = (
    ("doc: {id: 1}", None), ("a: 1\na: 2", "yaml_duplicate_key"), ("a: &x 1\nb: *x", "yaml_alias"), ("a: &x {k: 1}\nb: {<<: *x}", "yaml_merge_key"), ("a: !t 1", "yaml_custom_tag"), ("1: a", "yaml_non_string_key"),
    ("a: " + "[" * 64 + "]" * 64, "yaml_limit"), ("a: 9007199254740992", "number_out_of_range"), ("a: -0.0", "number_negative_zero"), ("a: [", "yaml_parse_error"), ("- 1", "yaml_parse_error"),
)


@query("synth_decode_errors", "SELECT 'doc/' || doc_id AS path, CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(DEFECTS) if kind) + " END AS kind FROM documents")
def decode_errors(spark, d):
    head = F.element_at(F.array(*[F.lit(t) for t, _ in DEFECTS]), (F.col("doc_id") % len(DEFECTS) + 1).cast("int"))
    return decode_table(artifacts(spark, d, lines("---\n", head, "\n---\n")), "text").select("path", "kind")


@query("utf8_errors", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'artifact_invalid_utf8' END AS kind FROM documents")
def utf8_errors(spark, d):
    from fathomline.sources.documents import decode_files

    body = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("2D2DFF"))).otherwise(F.lit("---\na: 1\n---\n").cast("binary"))
    return decode_files(read(spark, d, "documents").select("doc_id", body.alias("content"))).select("doc_id", "kind")


def layout(k: int):
    meta = "---\nfathom: corpus:Doc/v1\n"
    return (
        lines(meta, "doc:\n  id: 1\n  lang: en\n---\n"), lines(meta, "a: {}\nb: {}\n---\n"), lines(meta, "---\n"), lines(meta, "doc: [1]\n---\n"), lines("---\nfathom: {contract: corpus:Doc/v1, envelope: other}\ndoc: {}\n---\n"), lines("plain text"),
    )[k]


def by_remainder(n: int, make):
    column = make(n - 1)
    for k in range(n - 1):
        column = F.when(F.col("doc_id") % n == k, make(k)).otherwise(column)
    return column


@query("synth_envelope_cases", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'envelope_ambiguous' WHEN 2 THEN 'envelope_missing' WHEN 3 THEN 'envelope_not_mapping' WHEN 4 THEN 'envelope_mismatch' ELSE 'no_frontmatter' END AS kind,
       CASE doc_id % 6 WHEN 0 THEN 'valid' ELSE 'invalid' END AS outcome FROM documents
""")
def envelope_cases(spark, d):
    results = validate_corpus(decode_table(artifacts(spark, d, by_remainder(6, layout)), "text"), [DOC_CONTRACT], SCHEMAS)
    return results.select("path", F.get("errors", F.lit(0))["kind"].alias("kind"), "outcome")


@query("corpus_violations", """
SELECT 'doc/' || doc_id AS path, '/id' AS json_path, 'value ' || doc_id || ' is greater than the maximum of 500' AS message FROM documents WHERE doc_id > 500
UNION ALL SELECT 'doc/' || doc_id, '/lang', 'value ''' || lang || ''' is not one of [''en'', ''de'']' FROM documents WHERE lang NOT IN ('en', 'de')
""")
def corpus_violations(spark, d):
    return error_rows(validate_corpus(decode_table(artifacts(spark, d, good()), "text"), [DOC_CONTRACT], SCHEMAS)).select("path", "json_path", "message")


@query("synth_binding_precedence", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'document' ELSE 'none' END AS schema_source,
       CASE doc_id % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'own' ELSE 'only' END AS envelope_key, CASE doc_id % 3 WHEN 0 THEN 'enforced' ELSE 'soft' END AS status FROM documents
""")
def binding_precedence(spark, d):
    def make(k):
        return (
            lines("---\nfathom: {contract: corpus:Host/v1, schema: other.yaml, envelope: own, status: soft}\ndoc: {}\nown: {}\n---\n"),
            lines("---\nfathom: {contract: corpus:Free/v1, schema: doc.schema.yaml, envelope: own}\ndoc: {}\nown: {}\n---\n"),
            lines("---\nfathom: corpus:Free/v1\nonly: {}\n---\n"),
        )[k]

    host = Contract("corpus:Host/v1", envelope_key="doc", status="enforced", schema_ref="doc.schema.yaml")
    return validate_corpus(
        decode_table(artifacts(spark, d, by_remainder(3, make)), "text"), [host, Contract("corpus:Free/v1")],
        SCHEMAS,
    ).select("path", "schema_source", "envelope_key", "status")


@query("synth_status_warnings", """
SELECT 'doc/' || doc_id AS path, 'document-status-mismatch' AS code, 'document declares status ''enforced''; contract uses ''soft''' AS message FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT 'doc/' || doc_id, 'document-contract-mismatch', 'document declares ''corpus:Other/v2''; contract uses ''corpus:Doc/v1''' FROM documents WHERE doc_id % 4 = 2
""")
def status_warnings(spark, d):
    def make(k):
        meta = ("corpus:Doc/v1", "{contract: corpus:Doc/v1, status: enforced}", "corpus:Other/v2", "{contract: corpus:Doc/v1, status: soft}")[k]
        return lines(f"---\nfathom: {meta}\ndoc: {{id: 1, lang: en}}\n---\n")

    docs = decode_table(artifacts(spark, d, by_remainder(4, make)), "text").withColumn("host", F.lit("corpus:Doc/v1"))
    return warning_rows(validate_corpus(docs, [DOC_CONTRACT], SCHEMAS, contract_col="host", metadata_mode="advisory")).select("path", "code", "message")


@query("metadata_errors", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 5 WHEN 1 THEN 'unknown metadata keys: owner' WHEN 2 THEN 'malformed contract ID ''bad id''' WHEN 3 THEN 'metadata must be a string or mapping, got list' WHEN 4 THEN 'status must be soft, permissive or enforced' END AS error FROM documents
""")
def metadata_errors(spark, d):
    def make(k):
        meta = ("corpus:Doc/v1", "{contract: corpus:Doc/v1, owner: me}", "bad id", "[a]", "{contract: corpus:Doc/v1, status: odd}")[k]
        return lines(f"---\nfathom: {meta}\ndoc: {{}}\n---\n")

    return binding.metadata(decode_table(artifacts(spark, d, by_remainder(5, make)), "text")).select("path", F.col("meta.error").alias("error"))


@query("pure_yaml_payload", "SELECT 'doc/' || doc_id AS path, 'valid' AS outcome, '{\"id\":' || doc_id || ',\"lang\":\"en\"}' AS payload_json FROM documents WHERE doc_id <= 500 UNION ALL SELECT 'doc/' || doc_id, 'invalid', '{\"id\":' || doc_id || ',\"lang\":\"en\"}' FROM documents WHERE doc_id > 500")
def pure_yaml_payload(spark, d):
    text = lines("fathom: corpus:Doc/v1\nid: ", F.col("doc_id"), "\nlang: en\n")
    docs = decode_table(artifacts(spark, d, text), "text", "pure-yaml")
    return validate_corpus(docs, [DOC_CONTRACT], SCHEMAS, profile="pure-yaml").select("path", "outcome", "payload_json")


@query("contract_id_grammar", r"""
SELECT doc_id, id, regexp_full_match(id, '(?:[a-z0-9_]+(?:\.[a-z0-9_]+)*:)?[A-Za-z_][A-Za-z0-9_]*(?:/[A-Za-z0-9_.-]+)?') AS ok FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ':Doc/' || source WHEN 1 THEN source || ' ' || lang WHEN 2 THEN '9' || source ELSE 'a.b:' || source END AS id FROM documents)
""")
def contract_id_grammar(spark, d):
    made = F.when(
        F.col("doc_id") % 4 == 0, F.concat("lang", F.lit(":Doc/"), "source"),
    ).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit(" "), "lang")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("9"), "source")).otherwise(F.concat(F.lit("a.b:"), "source"))
    return read(spark, d, "documents").select("doc_id", made.alias("id")).withColumn("ok", binding.is_contract_id(F.col("id")))


@query("inspect_envelope_keys", "SELECT 'doc/' || doc_id AS path, true AS has_frontmatter, 'corpus:Doc/v1' AS contract, 'zeta,alpha' AS envelope_keys FROM documents")
def inspect_envelope_keys(spark, d):
    docs = decode_table(artifacts(spark, d, lines("---\nzeta: 1\nfathom: corpus:Doc/v1\nalpha: 2\n---\n")), "text")
    return inspect_corpus(docs).select(
        "path", "has_frontmatter", F.col("meta.contract").alias("contract"),
        F.concat_ws(",", "envelope_keys").alias("envelope_keys"),
    )


@query("missing_files", "SELECT 'doc/' || doc_id AS path, 'artifact_unreadable' AS kind FROM documents WHERE doc_id % 7 = 0")
def files_missing(spark, d):
    from fathomline.sources.documents import missing_files

    paths = artifacts(spark, d, F.lit(""))
    return missing_files(paths.select("path"), paths.where(F.split_part("path", F.lit("/"), F.lit(2)).cast("long") % 7 != 0)).select("path", "kind")


# ---- schemas ------------------------------------------------------------------------------------------------------

MOVIE = {
    "type": "object", "required": ["title", "rating"], "x-fathom": {"contract": "films:Movie/v1"},
    "properties": {
        "title": {
            "type": "string", "description": "Its name", "x-fathom": {"group": "core"},
        }, "rating": {"anyOf": [{"enum": ["G", "PG|13"], "type": "string"}, {"type": "null"}]},
        "cast": {"type": "array", "items": {"$ref": "#/$defs/Person"}}, "lead": {"$ref": "#/$defs/Person", "description": "Who leads"},
    },
    "$defs": {"Person": {"type": "object", "description": "Someone", "properties": {"name": {"type": "string"}, "role": {"type": "string", "enum": ["actor", "voice"]}}, "required": ["name"]}},
}


def section_docs(spark, d):
    table = sections.enum_table(sections.SchemaFields(MOVIE))
    mark = lambda attrs, body: f"<!-- fathom:generated {attrs} -->\n{body}\n<!-- /fathom:generated -->"
    fresh, stale, odd = mark('kind="enum_table" schema="movie"', table), mark('kind="enum_table" schema="movie"', "old"), mark('kind="enum_table" contract="movie"', "x")
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(f"a {fresh} b {stale}")).when(F.col("doc_id") % 3 == 1, F.lit(fresh)).otherwise(F.lit(odd))
    return artifacts(spark, d, text)


@query("section_drift", """
SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS sections, doc_id % 3 = 0 AS drift, (doc_id % 3 = 2)::BIGINT AS errors, CASE WHEN doc_id % 3 = 0 THEN 'doc/' || doc_id || ': section enum_table drifted' ELSE '' END AS drift_details FROM documents
""")
def section_drift(spark, d):
    found = sections.drift_by_document(sections.drift(sections.sections(section_docs(spark, d)), {"movie": MOVIE}))
    return found.withColumn("drift_details", F.concat_ws(";", "drift_details"))


@query("section_regenerate", "SELECT 'doc/' || doc_id AS path, doc_id % 3 = 0 AS changed FROM documents")
def section_regenerate(spark, d):
    done = sections.regenerate(section_docs(spark, d), {"movie": MOVIE})
    return done.select("path", (F.col("regenerated") != F.col("text")).alias("changed"))


from . import catalogue_cases, catalogue_schemas  # noqa: E402, F401  register their own
