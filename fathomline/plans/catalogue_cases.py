"""Registered queries over cases that the tables don't hold by themselves: each row of a table stands for a document or a
value that its id decides, and SQL says what the engine has to find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import sections
from fathomline.operators.corpus import error_rows, validate_corpus
from fathomline.operators.fields import SchemaFields
from fathomline.operators.validate import Contract, violations
from fathomline.operators.values import results_json, validate_values
from fathomline.sources.documents import decode_table, from_roots, text_of

from .canonical_texts import canonical_text
from .catalogue import DOC_CONTRACT, MOVIE, SCHEMAS, artifacts, by_remainder, lines, query, read


def id_of(path: str = "path"):
    return F.split_part(path, F.lit("/"), F.lit(2)).cast("long")


def texts_by_id(spark, d, texts: list[str]) -> DataFrame:
    """doc_id and v (VARIANT): texts[doc_id % n] with @ for the id."""
    text = F.replace(
        F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int")), F.lit("@"),
        F.col("doc_id").cast("string"),
    )
    return read(spark, d, "documents").select("doc_id", F.parse_json(text).alias("v"))


def keyword_query(name: str, schema: dict, texts: list[str], found: dict[int, list[tuple[str, str]]]) -> None:
    """A query of all violations of schema in texts; found: by remainder, json_path and validator."""
    cases = [f"SELECT doc_id, '{p}' AS json_path, '{v}' AS validator FROM documents WHERE doc_id % {len(texts)} = {k}" for k, rows in found.items() for p, v in rows]

    @query(name, " UNION ALL ".join(cases))
    def run(spark, d):
        return violations(
            texts_by_id(spark, d, texts), Contract(f"case:{name}/v1", schema), ["doc_id"], "v",
        ).select("doc_id", "json_path", "validator")


# ---- keywords -----------------------------------------------------------------------------------------------------

keyword_query(
    "array_sizes", {"properties": {"a": {"minItems": 2, "maxItems": 3}}},
    ['{"a":[]}', '{"a":[@]}', '{"a":[1,2]}', '{"a":[1,2,3,@]}'],
    {0: [("/a", "minItems")], 1: [("/a", "minItems")], 3: [("/a", "maxItems")]},
)
keyword_query(
    "contains_counts", {"contains": {"type": "string"}, "minContains": 1, "maxContains": 2},
    ['["@"]', "[@]", '["a","b","c"]'], {1: [("", "minContains")], 2: [("", "maxContains")]},
)
keyword_query(
    "prefix_items", {"prefixItems": [{"type": "integer"}, {"const": "kg"}], "items": False},
    ['[@,"kg"]', '["@","kg"]', '[@,"lb"]', '[@,"kg",0]'],
    {1: [("/0", "type")], 2: [("/1", "const")], 3: [("/2", "False schema")]},
)
keyword_query(
    "object_sizes", {"minProperties": 1, "maxProperties": 2}, ["{}", '{"a":@}', '{"a":1,"b":2,"c":3}'],
    {0: [("", "minProperties")], 2: [("", "maxProperties")]},
)
keyword_query(
    "pattern_properties",
    {"patternProperties": {"_id$": {"type": "integer"}}, "additionalProperties": {"type": "string"}},
    ['{"a_id":@}', '{"a_id":"@"}', '{"b":"x"}', '{"b":@}'], {1: [("/a_id", "type")], 3: [("/b", "type")]},
)
keyword_query(
    "dependent_required", {"dependentRequired": {"card": ["expiry", "name"]}},
    ["{}", '{"card":@}', '{"card":1,"expiry":2,"name":3}'],
    {1: [("", "dependentRequired"), ("", "dependentRequired")]},
)
keyword_query("property_names", {"propertyNames": {"maxLength": 3}}, ['{"abc":1}', '{"abcd":@,"x":2}'], {1: [("", "maxLength")]})
keyword_query(
    "dependent_schemas", {"dependentSchemas": {"card": {"properties": {"pin": {"minimum": 1000}}}}},
    ['{"pin":1}', '{"card":1,"pin":1}', '{"card":1,"pin":1234}'], {1: [("/pin", "minimum")]},
)
keyword_query(
    "unevaluated_properties",
    {"anyOf": [{"properties": {"lat": {}}, "required": ["lat"]}, {"properties": {"x": {}}, "required": ["x"]}], "unevaluatedProperties": False},
    ['{"lat":@}', '{"lat":1,"x":2}', '{"lat":1,"y":2}'], {2: [("", "unevaluatedProperties")]},
)
keyword_query(
    "unevaluated_items", {"prefixItems": [True], "unevaluatedItems": {"type": "integer"}}, ['["@",1]', '[1,"@"]'],
    {1: [("", "unevaluatedItems")]},
)
keyword_query(
    "one_of", {"oneOf": [{"required": ["a"]}, {"required": ["b"]}], "not": {"required": ["c"]}},
    ['{"a":@}', '{"a":1,"b":2}', "{}", '{"b":1,"c":@}'], {1: [("", "oneOf")], 2: [("", "oneOf")], 3: [("", "not")]},
)
keyword_query(
    "big_numbers", {"properties": {"n": {"type": "integer"}, "m": {"multipleOf": 0.1}, "t": {"multipleOf": 1e-13}}},
    ['{"n":9.3e18}', '{"n":1e300}', '{"n":0.5}', '{"m":1e30}', '{"m":0.35}', '{"t":1e30}', '{"m":-0.3}'],
    {2: [("/n", "type")], 4: [("/m", "multipleOf")]},
)
keyword_query(
    "odd_names",
    {"properties": {'a"b': {"minimum": 5}, "it's": {"minimum": 5}, "q\"'": {"minimum": 5}, "": {"minimum": 5}}, "required": ['a"b']}, ['{"a\\"b":1}', '{"it\'s":1,"a\\"b":9}', '{"q\\"\'":1,"a\\"b":9}', '{"":1}'], {0: [("/a\"b", "minimum")],
    1: [("/it''s", "minimum")], 2: [("/q\"''", "minimum")], 3: [("", "required"), ("/", "minimum")]},
)


@query("pattern_braces", r"SELECT event_id, 'pattern' AS validator FROM events WHERE NOT regexp_matches(props, '^\{.*[13579]\}$')")
def pattern_braces(spark, d):
    contract = Contract("case:Braces/v1", {"properties": {"props": {"pattern": "^{.*[13579]}$"}}})
    return violations(read(spark, d, "events").select("event_id", "props"), contract, ["event_id"]).select("event_id", "validator")


@query("event_value_number", "SELECT event_id, 'multipleOf' AS validator FROM events WHERE (round(value * 100)::BIGINT) % 25 <> 0")
def event_value_number(spark, d):
    return violations(
        read(spark, d, "events").select("event_id", "value"),
        Contract("case:Value/v1", {"properties": {"value": {"multipleOf": 0.25}}}), ["event_id"],
    ).select("event_id", "validator")


# ---- corpora ------------------------------------------------------------------------------------------------------


def corpus(spark, d, n: int, text, contracts=(DOC_CONTRACT,), schemas=SCHEMAS, **more) -> DataFrame:
    docs = decode_table(artifacts(spark, d, by_remainder(n, text)), "text")
    return validate_corpus(docs, list(contracts), schemas, **more)


@query("semantic_models", """
SELECT 'doc/' || doc_id AS path, doc_id % 3 <> 1 AS semantic_ok, CASE doc_id % 3 WHEN 2 THEN 'no_semantic_model' END AS semantic_skipped, CASE WHEN doc_id % 3 = 2 THEN 'no_schema' ELSE 'inferred_via_model' END AS structural_skipped,
       doc_id % 3 = 1 AS disagrees FROM documents
""")
def semantic_models(spark, d):
    from .example_models import Move

    def text(k):
        return (
            lines("---\nfathom: case:Move/v1\nm: {direction: up, delta: ", F.col("doc_id"), "}\n---\n"),
            lines("---\nfathom: case:Move/v1\nm: {direction: down, delta: 0}\n---\n"),
            lines("---\nfathom: case:Free/v1\nm: {}\n---\n"),
        )[k]

    found = corpus(spark, d, 3, text, (Contract("case:Move/v1"), Contract("case:Free/v1")), {}, models={"case:Move/v1": Move})
    return found.select(
        "path", "semantic_ok", "semantic_skipped", "structural_skipped",
        F.exists("semantic_errors", lambda e: e.contains("disagree")).alias("disagrees"),
    )


@query("semantic_rows", "SELECT l_orderkey, l_linenumber, l_shipdate >= o_orderdate AS semantic_ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def semantic_rows(spark, d):
    from .example_models import Shipment

    first = read(spark, d, "lineitem").where("l_linenumber = 1").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = first.select(
        "l_orderkey", "l_linenumber",
        F.to_json(F.struct(F.col("l_shipdate").cast("string").alias("l_shipdate"), F.col("o_orderdate").cast("string").alias("o_orderdate"))).alias("j"),
    )
    return validate_values(rows, model=Shipment, column="j").select("l_orderkey", "l_linenumber", "semantic_ok")


@query("registry_lookup", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'known' ELSE 'contract_unknown' END AS found FROM documents")
def registry_lookup(spark, d):
    text = lines("---\nfathom: ", F.col("source"), "\nd: {}\n---\n")
    found = validate_corpus(decode_table(artifacts(spark, d, text), "text"), [Contract(f"src{k}") for k in range(3)], {})
    return found.select(id_of().alias("doc_id"), F.coalesce(F.get("errors", F.lit(0))["kind"], F.lit("known")).alias("found"))


@query("skip_reasons", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'no_semantic_model' WHEN 1 THEN 'no_semantic_model' ELSE 'no_frontmatter' END AS semantic_skipped, CASE doc_id % 3 WHEN 1 THEN 'no_schema' END AS structural_skipped FROM documents
""")
def skip_reasons(spark, d):
    text = lambda k: (
        lines("---\nfathom: corpus:Doc/v1\ndoc: {id: 1, lang: en}\n---\n"),
        lines("---\nfathom: case:Free/v1\ndoc: {}\n---\n"), lines("words"),
    )[k]
    return corpus(spark, d, 3, text, (DOC_CONTRACT, Contract("case:Free/v1"))).select("path", "semantic_skipped", "structural_skipped")


@query("inferred_bindings", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'a:One' WHEN 1 THEN 'a:Two' WHEN 2 THEN '<unknown>' ELSE 'a:One' END AS contract_id, CASE doc_id % 4 WHEN 0 THEN 'enforced' ELSE 'soft' END AS status,
       CASE doc_id % 4 WHEN 0 THEN 'additionalProperties' WHEN 2 THEN 'contract_unknown' END AS error FROM documents
""")
def inferred_bindings(spark, d):
    def text(k):
        body = "\ndoc: {id: 1, lang: en, more: 1}\n---\n"
        return (
            lines("---\nfathom: {contract: a:One, status: enforced, schema: doc.schema.yaml}" + body),
            lines("---\nfathom: a:Two" + body), lines("---\ndoc: {}\n---\n"),
            lines("---\nfathom: {contract: a:One, schema: doc.schema.yaml}" + body),
        )[k]

    first = F.get("errors", F.lit(0))
    return corpus(spark, d, 4, text, (), infer=True).select(
        "path", "contract_id", "status", F.coalesce(first["validator"], first["kind"]).alias("error"),
    )


@query("warning_codes", "SELECT 'doc/' || doc_id AS path, CASE doc_id % 2 WHEN 1 THEN 'document-status-mismatch' ELSE '' END AS codes FROM documents")
def warning_codes(spark, d):
    text = lambda k: lines("---\nfathom: {contract: corpus:Doc/v1, status: " + ("soft", "permissive")[k] + "}\ndoc: {id: 1, lang: en}\n---\n")
    return corpus(spark, d, 2, text).select("path", F.concat_ws(",", "warning_codes").alias("codes"))


@query("schema_paths", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'maximum' WHEN 1 THEN 'maximum' ELSE 'schema_missing' END AS error, CASE doc_id % 5 WHEN 2 THEN 'schema must be a relative path: /doc/s.yaml' WHEN 3 THEN 'schema escapes the document directory: ../doc/s.yaml' WHEN 4 THEN 'compiled schema not found: t.yaml' END AS message FROM documents
""")
def schema_paths(spark, d):
    ref = ("./s.yaml", "x/../s.yaml", "/doc/s.yaml", "../doc/s.yaml", "t.yaml")
    text = lambda k: lines("---\nfathom: {contract: a:One, schema: " + ref[k] + "}\nv: {n: 9}\n---\n")
    first = F.get("errors", F.lit(0))
    found = corpus(spark, d, 5, text, (Contract("a:One"),), {"doc/s.yaml": {"properties": {"n": {"maximum": 5}}}})
    return found.select(
        "path", F.coalesce(first["validator"], first["kind"]).alias("error"),
        F.when(first["validator"].isNull(), first["message"]).alias("message"),
    )


@query("schema_resources", "SELECT 'doc/' || doc_id AS path, '/home' AS json_path, 'required' AS validator FROM documents WHERE doc_id % 2 = 1")
def schema_resources(spark, d):
    text = lambda k: lines("---\nfathom: {contract: a:One, schema: s.yaml}\nv: {home: {" + ("berths: 1", "")[k] + "}}\n---\n")
    schemas = {"s.yaml": {"properties": {"home": {"$ref": "tag:harbour,2020:port"}}}}
    found = corpus(spark, d, 2, text, (Contract("a:One"),), schemas, resources={"tag:harbour,2020:port": {"required": ["berths"]}})
    return error_rows(found).select("path", "json_path", "validator")


@query("decoded_roots", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 3 WHEN 1 THEN 'number_out_of_range' WHEN 2 THEN 'number_negative_zero' END AS kind, true AS unguarded FROM documents
""")
def decoded_roots(spark, d):
    root = by_remainder(3, lambda k: F.lit(('{"a": [1, "x"]}', '{"a": 9007199254740992}', '{"a": -0.0}')[k]))
    rows = artifacts(spark, d, root)
    free = from_roots(rows, "text").select("path", F.col("kind").isNull().alias("unguarded"))
    return from_roots(rows, "text", guard=True).select("path", "kind").join(free, "path")


@query("json_results", """SELECT event_id, '{"a":null,"event_id":' || event_id || ',"n":' || (event_id % 7) || ',"s":{"h":' || (CASE WHEN event_id % 2 = 0 THEN (event_id // 2)::VARCHAR ELSE (event_id // 2)::VARCHAR || '.5' END) || '}}' AS json FROM events""")
def json_results(spark, d):
    id_ = F.col("event_id")
    rows = read(spark, d, "events").select(
        "event_id", F.struct((id_ / 2).alias("h")).alias("s"), (id_ % 7).cast("double").alias("n"),
        F.lit(None).cast("string").alias("a"),
    )
    return results_json(rows).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "json")


@query("canonical_json_sha", """
SELECT n_nationkey, sha256('{"half":' || (CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey // 2)::VARCHAR ELSE (n_nationkey // 2)::VARCHAR || '.5' END) || ',"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS sha FROM nation
""")
def canonical_json_sha(spark, d):
    text = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("key"), (F.col("n_nationkey") / 2).alias("half")))
    return read(spark, d, "nation").select("n_nationkey", F.sha2(canonical_text(text).cast("binary"), 256).alias("sha"))


# ---- sections -----------------------------------------------------------------------------------------------------


@query("section_newlines", "SELECT 'doc/' || doc_id AS path, doc_id % 2 = 1 AS drift FROM documents")
def section_newlines(spark, d):
    body = sections.field_list(SchemaFields(MOVIE)).replace("\n", "\r\n")
    text = lambda k: F.lit(f'a\r\n<!-- fathom:generated kind="field_list" schema="movie" -->\r\n{body if k == 0 else "old"}\r\n<!-- /fathom:generated -->\r\n')
    files = artifacts(spark, d, by_remainder(2, text)).select("path", F.col("text").cast("binary").alias("content"))
    return sections.drift(sections.sections(text_of(files)), {"movie": MOVIE}).select("path", "drift")


@query("section_attributes", "SELECT 'doc/' || doc_id AS path, 'fathom:generated: attributes that no marker has: deck, ton' AS error FROM documents")
def section_attributes(spark, d):
    text = F.lit('<!-- fathom:generated kind="vocab" ton="1" schema="movie" deck="2" -->x<!-- /fathom:generated -->')
    return sections.sections(artifacts(spark, d, text)).select("path", "error")
