"""Registered queries over schemas as a table: each row of a table gives a schema, a contract or a model, and SQL says from the
row's columns what the engine has to find in it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.canonical import digest
from fathomline.operators import binding, sections
from fathomline.operators.corpus import error_rows, validate_corpus
from fathomline.operators.fields import field_table, identities
from fathomline.operators.schemas import canonical_forms, load_errors, located, schema_drift
from fathomline.operators.validate import Contract, item_violations, violations
from fathomline.sources.documents import decode_table, from_roots

from .canonical_texts import canonical_text
from .catalogue import artifacts, by_remainder, lines, query, read
from .catalogue_cases import keyword_query


def filled(template: str, **columns: str) -> Column:
    """A text with each @name replaced by a column."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit(f"@{name}"), F.col(column).cast("string"))
    return out


def by_key(key: str, *texts: Column) -> Column:
    return F.get(F.array(*texts), (F.col(key) % len(texts)).cast("int"))


MOVIE = {
    "type": "object", "required": ["title", "rating"], "x-fathom": {"contract": "films:M@key/v1", "schema_sha256": "of@key", "tier": "@nation"},
    "properties": {
        "title": {"type": "string", "description": "Its name: @name", "x-fathom": {"group": "g@nation"}},
        "rating": {"anyOf": [{"enum": ["G", "PG|@key"], "type": "string"}, {"type": "null"}]},
        "cast": {"type": "array", "items": {"$ref": "#/$defs/Person"}}, "lead": {"$ref": "#/$defs/Person", "description": "Who leads"},
        "either": {"type": ["string", "integer"]},
    },
    "$defs": {"Person": {"type": "object", "description": "Someone", "properties": {"name": {"type": "string"}, "role": {"type": "string", "enum": ["actor", "voice@nation"]}, "next": {"$ref": "#/$defs/Person"}}, "required": ["name"]}},
}
IDENTIFIED = {"$id": "tag:films,2020:@key", **MOVIE}


def movies(spark, d) -> DataFrame:
    """A catalogue: a schema for each supplier; every other one has an $id."""
    text = by_key("s_suppkey", *[filled(json.dumps(s), key="s_suppkey", nation="s_nationkey", name="s_name") for s in (MOVIE, IDENTIFIED)])
    return read(spark, d, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey")).alias("schema_ref"), text.alias("schema_text"))


# ---- navigation -----------------------------------------------------------------------------------------------------


@query("schema_fields", """
SELECT 's/' || s_suppkey AS schema_ref, ordinal, pointer, name, json_type, replace(replace(enum_values, '@key', s_suppkey::VARCHAR), '@nation', s_nationkey::VARCHAR) AS enum_values, required,
  replace(description, '@name', s_name) AS description, replace(softmeta, '@nation', s_nationkey::VARCHAR) AS softmeta
FROM supplier, (VALUES (0, '/properties/title', 'title', 'string', NULL, true, 'Its name: @name', '{"group":"g@nation"}'), (1, '/properties/rating', 'rating', 'string', 'G,PG|@key', true, NULL, '{}'),
  (2, '/properties/cast', 'cast', 'array', NULL, false, NULL, '{}'), (3, '/properties/lead', 'lead', 'object', NULL, false, 'Who leads', '{}'), (4, '/properties/lead/properties/name', 'name', 'string', NULL, true, NULL, '{}'),
  (5, '/properties/lead/properties/role', 'role', 'string', 'actor,voice@nation', false, NULL, '{}'), (6, '/properties/lead/properties/next', 'next', NULL, NULL, false, NULL, '{}'), (7, '/properties/either', 'either', NULL, NULL, false, NULL, '{}'))
  AS t(ordinal, pointer, name, json_type, enum_values, required, description, softmeta)
""")
def schema_fields(spark, d):
    found = field_table(movies(spark, d))
    return found.select("schema_ref", "ordinal", "pointer", "name", "json_type", F.array_join("enum", ",").alias("enum_values"), "required", "description", "softmeta")


@query("fields_by_group", "SELECT 's/' || s_suppkey AS schema_ref, '/properties/title' AS pointer FROM supplier WHERE s_nationkey <= 12")
def fields_by_group(spark, d):
    found = field_table(movies(spark, d)).withColumn("grp", F.get_json_object("softmeta", "$.group"))
    return found.where(F.col("grp").isin(*(f"g{k}" for k in range(13)))).select("schema_ref", "pointer")


@query("field_at_pointer", "SELECT 's/' || s_suppkey AS schema_ref, 'actor,voice' || s_nationkey AS enum_values FROM supplier")
def field_at_pointer(spark, d):
    return field_table(movies(spark, d)).where("pointer = '/properties/lead/properties/role'").select("schema_ref", F.array_join("enum", ",").alias("enum_values"))


@query("schema_identity", """
SELECT 's/' || s_suppkey AS schema_ref, 'films:M' || s_suppkey || '/v1' AS contract_id, CASE WHEN s_suppkey % 2 = 1 THEN 'tag:films,2020:' || s_suppkey END AS schema_id, 'of' || s_suppkey AS schema_sha256,
  '{"contract":"films:M' || s_suppkey || '/v1","schema_sha256":"of' || s_suppkey || '","tier":"' || s_nationkey || '"}' AS root_softmeta, 'M' || s_suppkey AS short_name FROM supplier
""")
def schema_identity(spark, d):
    return identities(movies(spark, d)).withColumn("short_name", binding.short_name(F.col("contract_id")))


# ---- what sections say ----------------------------------------------------------------------------------------------


def rendered(spark, d, kind: str) -> DataFrame:
    return sections.rendered(movies(spark, d)).where(F.col("r_kind") == kind)


@query("section_enum_table", "SELECT 's/' || s_suppkey AS schema_ref, '| Field | Allowed values |' || chr(10) || '| --- | --- |' || chr(10) || '| `rating` | G, PG\\|' || s_suppkey || ' |' || chr(10) || '| `role` | actor, voice' || s_nationkey || ' |' AS body FROM supplier")
def section_enum_table(spark, d):
    return rendered(spark, d, "enum_table").select("schema_ref", "body")


@query("section_field_list", """
SELECT 's/' || s_suppkey AS schema_ref, '- `title` (string, required): Its name: ' || s_name || chr(10) || '- `rating` (string, required)' || chr(10) || '- `cast` (array, optional)' || chr(10) || '- `lead` (object, optional): Who leads' || chr(10) || '- `either` (object, optional)' AS body FROM supplier
""")
def section_field_list(spark, d):
    return rendered(spark, d, "field_list").select("schema_ref", "body")


@query("section_vocab", """
SELECT 's/' || s_suppkey AS schema_ref, '/properties/rating' AS pointer, '- `G`' || chr(10) || '- `PG|' || s_suppkey || '`' AS body FROM supplier
UNION ALL SELECT 's/' || s_suppkey, '/properties/lead/properties/role', '- `actor`' || chr(10) || '- `voice' || s_nationkey || '`' FROM supplier
""")
def section_vocab(spark, d):
    return rendered(spark, d, "vocab").select("schema_ref", F.col("r_pointer").alias("pointer"), "body")


@query("section_join", """
SELECT 'doc/' || doc_id AS path, doc_id % 3 = 1 AS drift, CASE WHEN doc_id % 3 = 2 THEN 'fathom:generated: no schema named s/none' END AS error FROM documents WHERE doc_id % 10 < 8 AND doc_id < (SELECT max(s_suppkey) FROM supplier) AND doc_id IN (SELECT s_suppkey FROM supplier)
""")
def section_join(spark, d):
    """Sections of many documents over as many schemas."""
    known = read(spark, d, "supplier")
    docs = read(spark, d, "documents").where("doc_id % 10 < 8").join(known, F.col("doc_id") == F.col("s_suppkey")).join(known.agg(F.max("s_suppkey").alias("last")), F.col("doc_id") < F.col("last"))
    mark = lambda ref, body: filled(f'<!-- fathom:generated kind="vocab" schema="{ref}" pointer="/properties/rating" -->\n{body}\n<!-- /fathom:generated -->', key="s_suppkey")
    text = by_key("doc_id", mark("s/@key", "- `G`\n- `PG|@key`"), mark("s/@key", "- `G`"), mark("s/none", "x"))
    found = sections.sections(docs.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), text.alias("text")))
    return sections.drift(found, movies(spark, d)).select("path", F.coalesce("drift", F.lit(False)).alias("drift"), "error")


@query("section_regenerate_join", """
SELECT 'doc/' || doc_id AS path, 'a <!-- fathom:generated kind="vocab" schema="s/' || doc_id || '" pointer="/properties/rating" -->' || chr(10) || '- `G`' || chr(10) || '- `PG|' || doc_id || '`' || chr(10) || '<!-- /fathom:generated --> b <!-- fathom:generated kind="vocab" schema="s/' || doc_id || '" pointer="/properties/lead/properties/role" -->'
  || chr(10) || '- `actor`' || chr(10) || '- `voice' || s_nationkey || '`' || chr(10) || '<!-- /fathom:generated --> c' AS text, 'doc/' || doc_id || ': section vocab drifted' AS details FROM documents JOIN supplier ON doc_id = s_suppkey
""")
def section_regenerate_join(spark, d):
    """Documents made anew from a catalogue of as many schemas; the second section is up to date."""
    docs = read(spark, d, "documents").join(read(spark, d, "supplier"), F.col("doc_id") == F.col("s_suppkey"))
    mark = lambda pointer, body: f'<!-- fathom:generated kind="vocab" schema="s/@key" pointer="{pointer}" -->{body}<!-- /fathom:generated -->'
    text = filled(f"a {mark('/properties/rating', 'old')} b {mark('/properties/lead/properties/role', chr(10) + '- `actor`' + chr(10) + '- `voice@nation`' + chr(10))} c", key="s_suppkey", nation="s_nationkey")
    docs = docs.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), text.alias("text"))
    told = sections.drift_by_document(sections.drift(sections.sections(docs), movies(spark, d))).select("path", F.concat_ws(";", "drift_details").alias("details"))
    return sections.rewritten(docs, movies(spark, d)).select("path", F.col("regenerated").alias("text")).join(told, "path")


# ---- checks and rewrites --------------------------------------------------------------------------------------------

#: A fault for each remainder, and kind and reason without and with the enforced overlay.
FAULTS = (
    ('{"properties": {"n": {"maximum": @key}}}', (None, None), (None, None)),
    ('{"pattern": "(?P<word>[a-z]+)@key"}', ("schema_invalid", "pattern"), ("schema_invalid", "pattern")),
    ('{"patternProperties": {"[@key": true}}', ("schema_invalid", "pattern"), ("schema_invalid", "pattern")),
    ('{"$ref": "tag:harbour,2020:@key"}', ("schema_invalid", "reference"), ("schema_invalid", "reference")),
    ('{"$defs": {"a": {"$id": "tag:x,2020:@key"}, "b": {"items": {"$id": "tag:x,2020:@key"}}}}', ("schema_invalid", "resource_identity"), ("schema_invalid", "resource_identity")),
    ('{"if": {"properties": {"n@key": {}}}}', (None, None), ("enforcement_unsupported", None)),
    ('{"minLength": -@key, "type": "text"}', ("schema_invalid", "dialect"), ("schema_invalid", "dialect")),
    ("[@key]", ("schema_invalid", "syntax"), ("schema_invalid", "syntax")),
    ("a: [@key", ("schema_invalid", "syntax"), ("schema_invalid", "syntax")),
    ('{"$ref": "#/$defs/a", "$defs": {"a": {"allOf": [{"$ref": "#/$defs/a"}], "title": "@key"}}}', ("schema_invalid", "reference"), ("schema_invalid", "reference")),
    ('{"$defs": {"a b": {"minimum": @key}}, "$ref": "#/$defs/a%20b"}', (None, None), (None, None)),
    ("type: object\nproperties:\n  n@key: {type: integer}\n", (None, None), (None, None)),
)
_sql = lambda x: "NULL" if x is None else f"'{x}'"
_FAULT_ROWS = ", ".join(f"({k}, {str(strict).lower()}, {_sql(kind)}, {_sql(reason)})" for k, (_, *by) in enumerate(FAULTS) for strict, (kind, reason) in zip((False, True), by, strict=True))


@query("schema_load_errors", f"SELECT 'p/' || p_partkey AS schema_ref, strict, load_kind, load_reason FROM part JOIN (VALUES {_FAULT_ROWS}) AS t(k, strict, load_kind, load_reason) ON p_partkey % {len(FAULTS)} = k")
def schema_load_errors(spark, d):
    text = by_key("p_partkey", *[filled(t, key="p_partkey") for t, *_ in FAULTS])
    return load_errors(read(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("schema_ref"), text.alias("schema_text"))).select("schema_ref", "strict", "load_kind", "load_reason")


_SAFE = 2**53 - 1
#: A schema for each remainder and its canonical form.
FORMS = (
    (f'{{"type":"integer","minimum":-{_SAFE},"maximum":@key}}', '{"maximum":@key,"type":"integer"}'),
    ('{"type":"object","propertyNames":{"type":"string"},"minProperties":@key}', '{"minProperties":@key,"type":"object"}'),
    ('{"oneOf":[{"type":"null"},{"minLength":@key,"type":"string"}]}', '{"anyOf":[{"type":"null"},{"minLength":@key,"type":"string"}]}'),
    ('{"required":["y@key","x"],"properties":{"required":{"required":["b","a@key"]}}}', '{"properties":{"required":{"required":["a@key","b"]}},"required":["x","y@key"]}'),
    ('{"oneOf":[{"type":"null"},{"type":"string"},{"const":@key.0}]}', '{"oneOf":[{"type":"null"},{"type":"string"},{"const":@key}]}'),
    ('{"x-own":{"required":["b","a"]},"default":-@key.50}', '{"default":-@key.5,"x-own":{"required":["b","a"]}}'),
)


@query("schema_canonical_form", "SELECT 'p/' || p_partkey AS schema_ref, canonical, sha256(canonical) AS schema_sha256 FROM (SELECT p_partkey, replace(CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, c) in enumerate(FORMS)) + " END, '@key', p_partkey::VARCHAR) AS canonical FROM part)")
def schema_canonical_form(spark, d):
    text = by_key("p_partkey", *[filled(t, key="p_partkey") for t, _ in FORMS])
    return canonical_forms(read(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("schema_ref"), text.alias("schema_text")))


@query("schema_drift", """
SELECT 's/' || s_suppkey AS schema_ref, s_suppkey % 4 IN (1, 2) AS drift,
  CASE s_suppkey % 4 WHEN 1 THEN 'committed schema at s/' || s_suppkey || ' differs from compile output' WHEN 2 THEN 'missing committed compiled schema at s/' || s_suppkey END AS drift_diff FROM supplier
""")
def schema_drift_(spark, d):
    rows = read(spark, d, "supplier").withColumn("schema_ref", F.concat(F.lit("s/"), F.col("s_suppkey")))
    text = lambda *t: by_key("s_suppkey", *[filled(x, key="s_suppkey") for x in t]).alias("schema_text")
    old = rows.where("s_suppkey % 4 <> 2").select("schema_ref", text('{"a":@key,"b":[1]}', '{"default":false,"a":@key}', "", '{"a":@key.0}'))
    new = rows.select("schema_ref", text('{ "b": [1],\n "a": @key }', '{"default":0,"a":@key}', '{"a":@key}', "a: @key\n"))
    return schema_drift(old, new)


@query("registry_conflicts", "SELECT source || ':Doc' AS id, count(DISTINCT lang)::BIGINT AS definitions FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) > 1")
def registry_conflicts(spark, d):
    rows = read(spark, d, "documents").where("source is not null and lang is not null")
    return binding.registry_conflicts(rows.select(F.concat("source", F.lit(":Doc")).alias("id"), F.col("lang").alias("envelope_key")))


@query("canonical_numbers", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey || '.5' WHEN 2 THEN (o_orderkey % 9 + 1) || 'e+21' WHEN 3 THEN '0.00000' || (o_orderkey % 9 + 1) WHEN 4 THEN '-' || o_orderkey WHEN 5 THEN (o_orderkey % 9 + 1) || '.5e-7'
  ELSE (o_orderkey % 9 + 1) || '00000000000000000000' END AS canonical FROM orders
""")
def canonical_numbers(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9 + 1).alias("small"))
    given = by_key("o_orderkey", *[filled(t, key="o_orderkey", small="small") for t in ("@key", "@key.50", "@smalle21", "0.00000@small", "-@key.0", "@small.5E-7", "@smalle20")])
    return rows.select("o_orderkey", canonical_text(given).alias("canonical"))


@query("canonical_key_order", """
SELECT doc_id, sha256('{"":0,"Z":1,"a' || doc_id || '":' || doc_id || ',"é":[{"a":null,"b":true}],"😀":3,"' || chr(57344) || '":4,"' || chr(65535) || '":5}') AS sha FROM documents
""")
def canonical_key_order(spark, d):
    """Keys by UTF-16 code unit: what is written with surrogates stands before U+E000 and above."""
    text = filled('{"@top":5, "@private":4, "😀":3, "é":[{"b":true,"a":null}], "a@key":@key, "Z":1.0, "":0}'.replace("@top", chr(65535)).replace("@private", chr(57344)), key="doc_id")
    return read(spark, d, "documents").select("doc_id", F.sha2(canonical_text(text).cast("binary"), 256).alias("sha"))


@query("canonical_refused", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a":[' || doc_id || ',{"b":"\\u001f"}]}' END AS canonical FROM documents
""")
def canonical_refused(spark, d):
    """A text that has a canonical form, then five that have none: a key twice, an integer beyond the safe range, a lone surrogate, two values, no JSON."""
    texts = ('{"a": [@key, {"b": "\\u001F"}]}', '{"a": @key, "a": 1}', '{"n": 9007199254740992@key}', '["\\ud83d@key"]', "[@key] [@key]", '{"a": @key')
    given = by_key("doc_id", *[filled(t, key="doc_id") for t in texts])
    return read(spark, d, "documents").select("doc_id", canonical_text(given).alias("canonical"))


# ---- models ---------------------------------------------------------------------------------------------------------


@query("compiled_model", """
SELECT s_suppkey, 'case:Ledger_' || s_suppkey || '/v2' AS contract_id, 'Opendate' || s_suppkey AS field_title,
  sha256('{"$id":"tag:case,2021:' || s_suppkey || '","$schema":"https://json-schema.org/draft/2020-12/schema","properties":{"openDate' || s_suppkey || '":{"title":"Opendate' || s_suppkey || '","type":"integer","x-fathom":{"group":"g' || s_nationkey || '","order":1}},"total":{"anyOf":[{"type":"integer"},{"type":"null"}],"default":null,"title":"Total"}},"required":["openDate' || s_suppkey || '"],"title":"Ledger_' || s_suppkey || '","type":"object","x-fathom":{"contract":"case:Ledger_' || s_suppkey || '/v2"}}') AS schema_sha256,
  true AS hash_is_of_the_rest FROM supplier
""")
def compiled_model(spark, d):
    """A model for each supplier, compiled where its row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pydantic

        from fathomline.operators.models import annotated, compile_model

        for batch in batches:
            rows = []
            for key, nation in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model = pydantic.create_model("Book", **{f"openDate{key}": (int, annotated(group=f"g{nation}", order=1, examples=[]))}, total=(int | None, None))
                made = compile_model(model, f"case:Ledger_{key}/v2", f"tag:case,2021:{key}")
                notes = made.schema["x-fathom"]
                bare = {**made.schema, "x-fathom": {k: v for k, v in notes.items() if k != "schema_sha256"}}
                rows.append((key, notes["contract"], made.schema["properties"][f"openDate{key}"]["title"], made.schema_sha256, digest(bare) == made.schema_sha256))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["s_suppkey", "contract_id", "field_title", "schema_sha256", "hash_is_of_the_rest"])

    rows = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long"))
    return rows.mapInArrow(run, "s_suppkey long, contract_id string, field_title string, schema_sha256 string, hash_is_of_the_rest boolean")


@query("named_models", "SELECT 'doc/' || doc_id AS path, doc_id % 2 = 0 AS semantic_ok FROM documents")
def named_models(spark, d):
    """Models by the names of their modules and classes."""
    from fathomline.operators.models import named_model

    text = lambda k: lines("---\nfathom: case:Move/v1\nm: {direction: " + ("up", "down")[k] + ", delta: ", F.col("doc_id"), "}\n---\n")
    docs = decode_table(artifacts(spark, d, by_remainder(2, text)), "text")
    model = named_model("fathomline.plans.example_models:Move")
    return validate_corpus(docs, [Contract("case:Move/v1")], {}, models={"case:Move/v1": model}).select("path", "semantic_ok")


# ---- files and streams ----------------------------------------------------------------------------------------------


@query("files_rewritten", """
SELECT 's' || s_suppkey || '.md' AS name, CASE s_suppkey % 3 WHEN 0 THEN 'v2 ' ELSE 'v1 ' END || s_name AS body, CASE s_suppkey % 3 WHEN 0 THEN 'replaced' WHEN 1 THEN 'conflict' END AS status FROM supplier
""")
def files_rewritten(spark, d):
    """A file for each supplier, rewritten in two steps where its text is the one that was read, and read back as a folder."""
    from fathomline.sources.documents import decode_files
    from fathomline.sources.folder import read_folder
    from fathomline.sources.rewrite import commit, rewrite, stage
    from fathomline.sources.shared import shared_folder

    root = shared_folder(spark, "rewritten")
    rows = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(f"{root}/s"), "s_suppkey", F.lit(".md")).alias("path"), "s_name")
    text = lambda v: F.concat(F.lit(f"---\na: 1\n---\n{v} "), "s_name")
    rewrite(rows.select("path", text("v1").alias("text"), F.lit(None).cast("string").alias("old")), root)
    newer = rows.where("s_suppkey % 3 < 2").select("path", text("v2").alias("text"), F.when(F.col("s_suppkey") % 3 == 0, text("v1")).otherwise(F.lit("another")).alias("old"))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    done = commit(spark, stage(newer, root)).select(name, "status")
    files = decode_files(read_folder(spark, root, "s*.md")).select(name, "body")
    return files.join(done, "name", "left")


@query("stream_updates", """
SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 3 = 1 THEN NULL WHEN (CASE WHEN doc_id % 3 = 0 THEN n_chars // 2 ELSE n_chars END) > 500 THEN 'invalid' ELSE 'valid' END AS outcome FROM documents) WHERE outcome IS NOT NULL GROUP BY outcome
""")
def stream_updates(spark, d):
    """Documents as a stream in which a third come again, changed, and a third are taken away: totals follow the latest versions."""
    from fathomline.sources.shared import shared_folder
    from fathomline.streaming.updates import changes, current, write_changes

    at = shared_folder(spark, "stream")
    rows = read(spark, d, "documents").select("doc_id", "n_chars")
    text = lines("---\nfathom: a:One\nv: {n: ", F.col("n"), "}\n---\n")
    versions = F.array(F.struct(F.lit(1).alias("version"), F.col("n_chars").alias("n")), F.struct(F.lit(2).alias("version"), F.expr("n_chars div 2").alias("n")))
    come = rows.select("doc_id", F.inline(versions)).where("version = 1 or doc_id % 3 < 2")
    come.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), text.alias("text"), "version", (F.col("version") * F.col("doc_id") % 3 == 2).alias("gone")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("path string, text string, version int, gone boolean").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    contract = Contract("a:One", schema_ref="n.json")
    results = validate_corpus(decode_table(stream, "text"), [contract], {"n.json": {"properties": {"n": {"maximum": 500}}}}, carry=("version", "gone"))
    write_changes(changes(results, "path", F.col("version"), ["outcome"], F.col("gone") & (F.col("version") == 2)), f"{at}/out", f"{at}/state").awaitTermination()
    return current(spark.read.schema("key string, version long, value string, sign int").parquet(f"{at}/out"), "outcome string")


@query("items_as_rows", """
SELECT vec_id, (k - 1)::INT AS item, '/' || (k - 1) AS json_path, CASE WHEN k <= 2 THEN 'minimum' ELSE 'maximum' END AS validator FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) WHERE (k <= 2 AND x < 0) OR (k > 2 AND x > 0.2::DOUBLE)
UNION ALL SELECT vec_id, NULL, '', 'maxItems' FROM embeddings WHERE len(embedding) > 63
""")
def items_as_rows(spark, d):
    """Each item of a vector as a row of its own, the vector's size beside them."""
    contract = Contract("ml:Items/v1", {"maxItems": 63, "prefixItems": [{"minimum": 0}, {"minimum": 0}], "items": {"type": "number", "maximum": 0.2}})
    return item_violations(read(spark, d, "embeddings"), contract, ["vec_id"], "embedding").select("vec_id", "item", "json_path", "validator")


# ---- documents and as many schemas ----------------------------------------------------------------------------------


@query("schema_per_document", """
SELECT 'doc/' || doc_id AS path, '/n' AS json_path, 'maximum' AS validator, (doc_id % 50)::VARCHAR AS validator_value FROM documents WHERE n_chars % 100 > doc_id % 50
""")
def schema_per_document(spark, d):
    """Every document names a schema of its own, beside it; the plan is the same as for one schema."""
    rows = read(spark, d, "documents")
    schemas = rows.select(F.concat(F.lit("doc/"), "doc_id", F.lit(".json")).alias("schema_ref"), F.concat(F.lit('{"properties":{"n":{"maximum":'), F.col("doc_id") % 50, F.lit("}}}")).alias("schema_text"))
    text = lines("---\nfathom: {contract: a:One, schema: ./x/../", F.col("doc_id"), ".json}\nv: {n: ", F.col("n_chars") % 100, "}\n---\n")
    docs = decode_table(rows.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), text.alias("text")), "text")
    return error_rows(validate_corpus(docs, [Contract("a:One")], schemas)).select("path", "json_path", "validator", "validator_value")


@query("schema_path_ranks", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'beside' WHEN 1 THEN 'here' WHEN 2 THEN 'beside' ELSE 'here' END AS title FROM documents
""")
def schema_path_ranks(spark, d):
    """A document's own reference prefers its folder, a host's the working folder; each takes the other where there is no first."""
    rows = read(spark, d, "documents")
    place = by_key("doc_id", *map(F.lit, ("both", "here", "beside", "both")))
    one = lambda where, folder: rows.where(place.isin(where, "both")).select(
        F.concat(F.lit(folder), "doc_id", F.lit(".json")).alias("schema_ref"), F.lit(f'{{"title":"{where}"}}').alias("schema_text"),
    )
    schemas = one("here", "").union(one("beside", "doc/"))
    docs = rows.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), "doc_id")
    source = F.when(F.col("doc_id") % 4 == 3, "host").otherwise("document")
    found = located(docs, schemas, F.concat(F.col("doc_id"), F.lit(".json")), F.col("path"), source)
    return found.select("path", F.get_json_object("schema_text", "$.title").alias("title"))


# ---- further rules of decoding, metadata and paths ------------------------------------------------------------------

keyword_query(
    "pointer_escapes", {"properties": {"a/b~c": {"minimum": 5}, "plain": {"format": "date", "contentMediaType": "text/plain", "type": "string"}}},
    ['{"a/b~c":1}', '{"a/b~c":@00}', '{"plain":"no date @"}', '{"plain":@}'], {0: [("/a~1b~0c", "minimum")], 3: [("/plain", "type")]},
)

@query("date_strings", """
SELECT o_orderkey, 'pattern' AS validator, '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '"' AS value FROM orders WHERE strftime(o_orderdate, '%Y') NOT IN ('1996', '1997')
UNION ALL SELECT o_orderkey, 'maxLength', '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '"' FROM orders WHERE o_orderstatus = 'F'
""")
def date_strings(spark, d):
    """Times are strings, in conditions too."""
    contract = Contract("case:Dates/v1", {
        "properties": {"o_orderdate": {"type": "string", "pattern": r"^199[67]-\d\d-\d\dT"}},
        "if": {"properties": {"o_orderstatus": {"const": "F"}}}, "then": {"properties": {"o_orderdate": {"maxLength": 10}}},
    })
    return violations(read(spark, d, "orders"), contract, ["o_orderkey"]).select("o_orderkey", "validator", "value")


@query("text_patterns", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[A-Z][a-z]+[.,] [A-Za-z]*on([^a-z]|$)')")
def text_patterns(spark, d):
    """Whole texts against a pattern that backtracking alone would take exponential time to refute."""
    contract = Contract("case:Text/v1", {"properties": {"text": {"pattern": r"[A-Z](?:[a-z]+)+[.,]\N{SPACE}(([A-Za-z]*)*)on([^a-z]|$)"}}})
    return violations(read(spark, d, "documents").select("doc_id", "text"), contract, ["doc_id"]).select("doc_id")


#: A head for each remainder of doc_id, and the kind it is found as (null: none).
HEADS = (
    ("a: .inf", "number_out_of_range"), ("a: -.INF", "number_out_of_range"), ("a: [.nan]", "number_out_of_range"), ('a: "\\uD800"', "yaml_parse_error"),
    ("doc:\n  text: |\n    one\n    ---\n    two", None), ("doc: {day: 2026-02-30}", None), ("doc: {n: 9007199254740991}", None), ("a: -9007199254740992", "number_out_of_range"),
)


@query("decode_scalars", "SELECT 'doc/' || doc_id AS path, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(HEADS) if kind) + " END AS kind, CASE doc_id % 8 WHEN 4 THEN 'one' || chr(10) || '---' || chr(10) || 'two' WHEN 5 THEN '2026-02-30' END AS kept FROM documents")
def decode_scalars(spark, d):
    head = by_key("doc_id", *[F.lit(t) for t, _ in HEADS])
    found = decode_table(artifacts(spark, d, lines("---\n", head, "\n---\n")), "text")
    return found.select("path", "kind", F.coalesce(F.get_json_object("root_json", "$.doc.text"), F.get_json_object("root_json", "$.doc.day")).alias("kept"))


@query("guarded_roots", "SELECT 'doc/' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'yaml_unsupported_scalar' WHEN 1 THEN 'number_out_of_range' END AS kind FROM documents")
def guarded_roots(spark, d):
    texts = ('{"a": ["\\ud800@key"]}', '{"a": 1e999, "b": @key}', '{"a": "\\ud83d\\ude00@key"}')
    rows = read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), by_key("doc_id", *[filled(t, key="doc_id") for t in texts]).alias("root"))
    return from_roots(rows, "root", guard=True).select("path", "kind")


@query("empty_metadata", """
SELECT 'doc/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'schema must be a non-empty string' WHEN 1 THEN 'envelope must be a non-empty string' WHEN 2 THEN 'contract must be a string' END AS error FROM documents
""")
def empty_metadata(spark, d):
    meta = ("{contract: a:One, schema: ''}", "{contract: a:One, envelope: 1}", "{schema: s.yaml}", "{contract: a:One, schema: null}")
    text = lambda k: lines(f"---\nfathom: {meta[k]}\ndoc: {{}}\n---\n")
    return binding.metadata(decode_table(artifacts(spark, d, by_remainder(4, text)), "text")).select("path", F.col("meta.error").alias("error"))
