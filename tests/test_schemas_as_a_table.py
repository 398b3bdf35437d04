"""Schemas in a catalogue: compiled once by content, found by joins; and the keywords that look at what others have evaluated."""

import json
import random
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.operators import schemas as tables
from fathomline.operators.corpus import error_rows, validate_corpus
from fathomline.operators.interpret import Evaluator, multiple
from fathomline.operators.schemas import Kept, catalogue, compiled, load_errors, located, schema_files
from fathomline.operators.validate import Contract, flat_record, item_violations, validate_rows, violations
from fathomline.plans.columns import Typed, compile_schema
from fathomline.plans.schema_tree import SchemaInvalid, load
from fathomline.sources.documents import decode_table


def test_what_is_compiled_is_kept_by_content_within_a_bound():
    kept = Kept(2)
    a, b, c = ('{"minimum": %d}' % k for k in range(3))
    first = compiled(a, False, kept=kept)
    assert compiled(a, False, kept=kept) is first and kept.made == 1
    assert compiled(a, True, kept=kept) is not first and kept.made == 2
    compiled(b, False, kept=kept)
    compiled(a, True, kept=kept)
    assert kept.made == 3 and len(kept.by_key) == 2
    compiled(a, False, kept=kept)
    assert kept.made == 4  # given up for others in between
    bad = compiled("[]", False, kept=kept)
    assert bad["reason"] == "syntax" and compiled("[]", False, kept=kept) is bad
    assert compiled(c, False, {"tag:x": {}}, kept=kept) is not compiled(c, False, {"tag:x": {"type": "null"}}, kept=kept)


def test_a_worker_compiles_each_text_once(spark):
    """Every row says how often its worker has compiled so far: never more than there are texts."""
    rows = spark.range(4000).select((F.col("id") % 5).cast("string").alias("k")).repartition(8)

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        tables.COMPILED.by_key.clear()
        tables.COMPILED.made = 0
        for batch in batches:
            for t in batch:
                compiled('{"title": "once %s"}' % t.as_py(), False)
            yield pa.array([[os.getpid(), tables.COMPILED.made]] * len(batch), pa.list_(pa.int64()))

    assert max(r.m for r in rows.select(run("k").alias("x")).select(F.col("x")[1].alias("m")).collect()) <= 5


def plan_size(df):
    return len(df._jdf.queryExecution().analyzed().toString())


def test_plans_don_t_grow_with_the_schemas(spark, tmp_path):
    docs = decode_table(spark.createDataFrame([(f"d/{k}", f"---\nfathom: {{contract: a:One, schema: {k}.json}}\nv: {{n: {k}}}\n---\n") for k in range(50)], "path string, text string"), "text")
    sizes = []
    for n in (1, 10_000):
        spark.range(n).select(F.concat(F.lit("d/"), "id", F.lit(".json")).alias("schema_ref"), F.lit('{"properties":{"n":{"maximum":20}}}').alias("schema_text")).write.parquet(str(tmp_path / str(n)))
        found = validate_corpus(docs, [Contract("a:One")], spark.read.parquet(str(tmp_path / str(n))))
        sizes.append(plan_size(found))
        kinds = [r.validator or r.kind for r in error_rows(found).collect()]
        assert kinds == (["schema_missing"] * 49 if n == 1 else ["maximum"] * 29)
    assert abs(sizes[0] - sizes[1]) < 0.05 * sizes[0]  # numbers of columns have more digits in the later one


def test_paths_are_ranked(spark):
    known = catalogue(spark, {"s.json": {"title": "here"}, "d/s.json": {"title": "beside"}, "./d/x/../t.json": {"title": "t"}, "d/t.json": {"title": "second by name"}, "/abs.json": {"title": "abs"}, "d/abs.json": {"title": "no"}})
    asked = [("host", "s.json"), ("document", "s.json"), ("host", "t.json"), ("document", "x/../t.json"), ("host", "/abs.json"), ("host", "/d/s.json"), ("none", "s.json"), ("host", None), ("document", "u.json")]
    docs = spark.createDataFrame([(k, "d/doc.md", *a) for k, a in enumerate(asked)], "k int, path string, source string, ref string")
    got = {r.k: r.t for r in located(docs, known, F.col("ref"), F.col("path"), F.col("source")).select("k", F.get_json_object("schema_text", "$.title").alias("t")).collect()}
    assert [got[k] for k in range(len(asked))] == ["here", "beside", "t", "t", "abs", None, None, None, None]


def test_schemas_from_files(spark):
    files = spark.createDataFrame([("f:/s/a.yaml", b"type: object\n"), ("f:/s/b.json", b"\xff"), ("f:/s/c.yaml", b"- 1\n")], "path string, content binary")
    found = load_errors(schema_files(files, "f:/s/")).where("not strict").collect()
    assert {r.schema_ref: r.load_reason for r in found} == {"a.yaml": None, "b.json": "syntax", "c.yaml": "syntax"}
    assert load_errors(catalogue(spark, {})).collect() == []


@pytest.mark.parametrize("schema", [
    {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}, {"allOf": [{"$ref": "#"}]}, {"properties": {"p": {"not": {"$ref": "#/properties/p"}}}},
    {"$defs": {"a": {"if": {"$ref": "#/$defs/b"}}, "b": {"anyOf": [{"$ref": "#/$defs/a"}]}}}, {"$ref": "#/$defs/none"}, {"dependentSchemas": {"x": {"$ref": "#"}}},
])
def test_references_that_lead_nowhere_are_refused(schema):
    with pytest.raises(SchemaInvalid) as e:
        load(schema)
    assert e.value.reason == "reference"


def test_references_that_step_into_the_value_are_fine():
    tree = load({"properties": {"a": {"$ref": "#"}}, "$defs": {"a b": {"type": "integer"}, "c/d": True}, "items": {"$ref": "#/$defs/a%20b"}, "contains": {"$ref": "#/$defs/c~1d"}})
    assert tree.recursive() and Evaluator(tree).violations(["x"])[0]["validator"] == "type"


TREE = {"$id": "tag:x,2020:tree", "$dynamicAnchor": "node", "type": "object", "properties": {"data": True, "children": {"type": "array", "items": {"$dynamicRef": "#node"}}}}
STRICT = {"$id": "tag:x,2020:strict", "$dynamicAnchor": "node", "$ref": "tag:x,2020:tree", "unevaluatedProperties": False}


def test_dynamic_references_lead_to_the_root_that_extends(spark):
    values = [{"children": [{"daat": 1}]}, {"children": [{"data": 1}]}, {"children": [{"children": [1]}]}, {"data": 1, "children": [{"children": [{"odd": 2}]}]}]
    plain, strict = load(TREE), load(STRICT, resources={"tag:x,2020:tree": TREE})
    assert [[r["path"] for r in Evaluator(plain).violations(v)] for v in values] == [[], [], [["children", "0", "children", "0"]], []]
    assert [[r["validator"] for r in Evaluator(strict).violations(v)] for v in values] == [["unevaluatedProperties"], [], ["type"], ["unevaluatedProperties"]]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "id int, j string").withColumn("v", F.parse_json("j"))
    for contract, tree in ((Contract("t:T/v1", TREE), plain), (Contract("t:T/v1", STRICT, resources={"tag:x,2020:tree": TREE}), strict)):
        got = {r.id: sorted((x["json_path"], x["validator"]) for x in r.violations) for r in validate_rows(df, contract, "v").collect()}
        assert [got[k] for k in range(len(values))] == [sorted((r["path"], r["validator"]) for r in Evaluator(tree).violations(v)) for v in values]


def test_deep_values_end():
    schema = {"$ref": "#/$defs/n", "$defs": {"n": {"anyOf": [{"properties": {"a": {"$ref": "#/$defs/n"}}, "additionalProperties": False}, {"type": "null"}]}}}
    value = None
    for _ in range(900):
        value = {"a": value}
    assert Evaluator(load(schema)).violations(value) == []
    for _ in range(20_000):
        value = [{"a": value}]
    nested = {"items": {"properties": {"a": {"$ref": "#"}}}}
    assert [r["validator"] for r in Evaluator(load(nested)).violations(value)] == ["nesting"]


def test_odd_numbers():
    assert [multiple(x, y) for x, y in ((float("inf"), 5), (float("nan"), 0.3), (10**400, 0.3), (10**400, 5), (2**53 + 1, 2), (2**53 + 1, 0.3), (12345678901234567890124, 4))] == [False, False, False, False, False, True, True]


# ---- columns against the interpreter --------------------------------------------------------------------------------

NUMBERS = ["1e400", "-1e400", str(2**53 + 1), str(2**63), str(10**37 + 2), "9" * 400, "4", "5.5", "0.30", "-6e20"]


@pytest.mark.parametrize("of", [5, 2, 0.3, 0.1, 1e20])
def test_multiples_of_numbers_of_any_size(spark, of):
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "id int, j string").withColumn("v", F.parse_json("j"))
    schema = {"multipleOf": of}
    got = sorted(r.id for r in violations(df, Contract("t:T/v1", schema), ["id"], "v").collect())
    assert got == [k for k, t in enumerate(NUMBERS) if Evaluator(load(schema)).violations(json.loads(t))]


LEAVES = [{"type": "integer"}, {"type": "string"}, {"minimum": 2}, {"maxLength": 1}, True, False, {"const": 1}]
VALUES = [0, 1, 2, 3.5, "a", "bb", None, True, [], [1], {}]


def some_schema(rng, depth=2):
    """A schema of keywords that mark properties and items as evaluated, and those that ask about the rest."""
    leaf = lambda: rng.choice(LEAVES)
    sub = lambda: some_schema(rng, depth - 1) if depth else leaf()
    out = {}
    for k in rng.sample(["properties", "patternProperties", "additionalProperties", "propertyNames", "dependentSchemas", "prefixItems", "items", "contains", "allOf", "anyOf", "oneOf", "not", "if", "$ref", "required"], rng.randint(0, 3)):
        match k:
            case "properties" | "dependentSchemas":
                out[k] = {n: sub() for n in rng.sample("abc", rng.randint(1, 2))}
            case "patternProperties":
                out[k] = {"^[cd]$": leaf()}
            case "propertyNames":
                out[k] = {"maxLength": 1}
            case "prefixItems" | "allOf" | "anyOf" | "oneOf":
                out[k] = [sub() for _ in range(rng.randint(1, 2))]
            case "if":
                out |= {"if": sub(), "then": sub(), "else": sub()}
            case "$ref":
                out[k] = "#/$defs/x"
            case "required":
                out[k] = [rng.choice("abc")]
            case _:
                out[k] = leaf()
    for k in ("unevaluatedProperties", "unevaluatedItems"):
        if rng.random() < 0.4:
            out[k] = rng.choice([False, {"type": "string"}, {"minimum": 2}])
    return out


def test_unevaluated_keywords_as_interpreted(spark):
    rng = random.Random(7)
    values = [{n: rng.choice(VALUES) for n in rng.sample(["a", "b", "c", "d", "ee"], rng.randint(0, 4))} for _ in range(12)] + [[rng.choice(VALUES) for _ in range(rng.randint(0, 4))] for _ in range(8)] + [1, "a"]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "id int, j string").withColumn("v", F.parse_json("j")).cache()
    hits = 0
    for _ in range(30):
        schema = some_schema(rng) | {"$defs": {"x": {"properties": {"b": {"minimum": 1}}, "prefixItems": [True]}}}
        found = validate_rows(df, Contract("t:T/v1", schema), "v").select("id", "violations")
        assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.id: sorted((x["json_path"], x["validator"], x["validator_value"]) for x in r.violations) for r in found.collect()}
        evaluator = Evaluator(load(schema))
        for k, v in enumerate(values):
            want = sorted((r["json_path"], r["validator"], r["validator_value"]) for r in map(flat_record, evaluator.violations(v)))
            assert got[k] == want, (schema, v)
            hits += any(w[1].startswith("unevaluated") for w in want)
    assert hits > 50


TYPED = "id int, s string, d double, dec decimal(20,3), day date, at timestamp, bytes binary, list array<double>, m map<string,double>, t struct<x:float>"
RECURSE = {"zz": {"$ref": "#"}}  # sends a schema to the interpreter


@pytest.mark.parametrize("properties", [
    {"s": {"type": "string", "minLength": 2}, "d": {"type": "number", "maximum": 5}, "dec": {"multipleOf": 0.5}, "day": {"type": "string", "pattern": "^2020"}, "at": {"type": "string", "maxLength": 3}, "bytes": {"type": "string", "const": "AP8="}},
    {"list": {"items": {"type": "number", "minimum": 0}}, "m": {"additionalProperties": {"type": "number", "maximum": 5}}, "t": {"properties": {"x": {"type": "integer"}}}, "day": {"enum": ["2020-02-29"]}, "at": {"type": "integer"}},
    {"d": {"multipleOf": 5}, "s": {"pattern": "\\N{BULLET}"}, "dec": {"type": "integer"}, "day": {"minimum": 3}},
])
def test_typed_rows_as_interpreted(spark, properties):
    inf = float("inf")
    rows = [
        (1, "[1", inf, None, None, None, None, [inf, 1.0, float("nan")], {"a": -inf}, (1.0,)), (2, "•", 2.5, 2, None, None, b"\0\xff", [-1.0], {"b": 6.0}, (float("inf"),)), (3, None, -inf, 3, None, None, b"", [], {}, None),
    ]
    df = spark.createDataFrame(rows, TYPED.replace("dec decimal(20,3)", "dec int")).withColumn("dec", (F.col("dec") / 4).cast("decimal(20,3)"))
    df = df.withColumn("day", F.expr("date_add(date'2020-02-28', id)")).withColumn("at", F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)"))
    columns = {r["id"]: [x.asDict() for x in r.violations] for r in validate_rows(df, Contract("t:T/v1", {"properties": properties})).collect()}
    rows_ = {r["id"]: [x.asDict() for x in r.violations] for r in validate_rows(df, Contract("t:T/v1", {"properties": properties | RECURSE})).collect()}
    assert columns == rows_ and any(columns.values())


def test_a_text_column_is_a_string_on_both_paths(spark):
    df = spark.createDataFrame([(1, "hello"), (2, '{"a": 1}'), (3, None)], "id int, t string")
    for schema in ({"type": "string", "minLength": 9}, {"type": "string", "minLength": 9, "properties": RECURSE}, {"minLength": 9, "pattern": "\\N{LATIN SMALL LETTER A}"}):
        found = violations(df, Contract("t:T/v1", schema), ["id"], "t").where("validator = 'minLength'").collect()
        assert [r.id for r in found] == [1, 2]


def test_dates_can_be_compiled_alone(spark):
    df = spark.sql("select date'2020-01-02' as d")
    assert df.where(compile_schema(load({"const": "2020-01-02"}), Typed(F.col("d"), df.schema["d"].dataType)).invalid()).count() == 0


# ---- recursion ------------------------------------------------------------------------------------------------------

RECURSIVE = [
    {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10}, "child": {"$ref": "#/$defs/node"}}}}},
    {"type": "object", "properties": {"k": {"maximum": 5}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "additionalProperties": False, "required": ["k", "kids"]},
    {"properties": {"k": {"type": "integer"}, "child": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}}, "required": ["k"]},
    {"$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/b"}}, "required": ["k"]}, "b": {"additionalProperties": {"$ref": "#/$defs/a"}, "patternProperties": {"^k": {"type": "integer"}}}}, "allOf": [{"$ref": "#/$defs/a"}]},
    {"prefixItems": [{"type": "integer"}], "items": {"$ref": "#"}, "maxItems": 3, "if": {"type": "object"}, "then": {"additionalProperties": {"$ref": "#"}}},
]


def some_value(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice([1, 20, "x", None, True, [], {}])
    if rng.random() < 0.3:
        return [some_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {n: rng.choice([1, 12, "s"]) if n == "k" else some_value(rng, depth - 1) for n in rng.sample(["k", "child", "kids", "b", "zz"], rng.randint(1, 4))}


@pytest.mark.parametrize("number", range(len(RECURSIVE)))
def test_recursive_schemas_as_interpreted_without_python(spark, number):
    rng = random.Random(number)
    values = [some_value(rng, 6) for _ in range(150)]
    deep = {"k": 1}
    for i in range(63):
        deep = {"k": i, "child": deep} if i % 2 else {"k": i, "child": deep, "kids": [deep]} if i < 6 else {"k": i, "child": deep}
    values.append(deep)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "id int, j string").withColumn("v", F.parse_json("j"))
    found = validate_rows(df, Contract("t:T/v1", RECURSIVE[number]), "v").select("id", "violations")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    plain = lambda r: (r["json_path"], r["validator"], r["validator_value"], *((r["value"], r["message"]) if r["value"][0] not in "[{" else ()))
    got = {r.id: sorted(plain(x.asDict()) for x in r.violations) for r in found.collect()}
    evaluator = Evaluator(load(RECURSIVE[number]))
    for k, v in enumerate(values):
        assert got[k] == sorted(plain(flat_record(r)) for r in evaluator.violations(v)), v
    assert sum(map(len, got.values())) > 20


def test_recursion_under_a_condition_is_interpreted(spark):
    df = spark.createDataFrame([(1, '{"a": {"a": 1}}'), (2, '{"a": {"a": {}}}')], "id int, j string").withColumn("v", F.parse_json("j"))
    found = violations(df, Contract("t:T/v1", {"properties": {"a": {"oneOf": [{"$ref": "#"}, {"type": "integer"}]}}, "type": "object"}), ["id"], "v")
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    assert found.collect() == []


def test_recursive_schemas_over_typed_rows_end_with_the_type(spark):
    df = spark.sql("select 1 as id, named_struct('k', 3, 'child', named_struct('k', 30, 'child', named_struct('k', 4))) as t")
    found = violations(df, Contract("t:T/v1", {"properties": {"t": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"properties": {"k": {"minimum": 10}, "child": {"$ref": "#/$defs/n"}}}}}), ["id"])
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.json_path for r in found.collect()] == ["/t/child/child/k", "/t/k"]


# ---- items as rows --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("variant", [False, True])
def test_items_as_rows_are_those_of_the_array(spark, variant):
    df = spark.createDataFrame([(1, [1.0, 5.5, 9.0]), (2, []), (3, None), (4, [None, -1.0])], "id int, a array<double>")
    if variant:
        df = df.select("id", F.parse_json(F.to_json("a")).alias("a"))
    schema = {"minItems": 1, "contains": {"maximum": 2}, "prefixItems": [{"exclusiveMinimum": 1}], "items": {"type": "number", "multipleOf": 0.5, "maximum": 5}}
    got = item_violations(df, Contract("t:T/v1", schema), ["id"], "a").collect()
    want = violations(df, Contract("t:T/v1", schema), ["id"], "a").collect()
    plain = lambda rows: sorted((r.id, r.json_path, r.validator, r.value, r.message) for r in rows)
    assert plain(got) == plain(want) and {r.item for r in got if r.json_path} == {0, 1, 2}


def test_one_long_array_is_checked_by_many_tasks(spark):
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda k: k.cast("double")).alias("a"))
    found = item_violations(df, Contract("t:T/v1", {"items": {"multipleOf": 100}, "maxItems": 10}), ["id"], "a")
    assert found.groupBy(F.spark_partition_id()).count().count() > 2 and found.count() == 198_001
    with pytest.raises(ValueError):
        item_violations(df, Contract("t:T/v1", {"unevaluatedItems": False}), ["id"], "a")
