"""The column compiler against the row interpreter."""

import json

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from pyspark.sql import functions as F

from fathomline.operators.interpret import Evaluator
from fathomline.operators.validate import Contract, flat_record, validate_rows, violations
from fathomline.plans.columns import java_pattern
from fathomline.plans.schema_tree import load

VALUES = [
    {}, {"k": 5}, {"k": 2.0, "s": "ab"}, {"k": 1.5, "s": "a\n", "tags": ["x", "yy", 3]}, {"k": True, "tags": []}, {"k": None, "s": "it's", "m": {"a": 1, "b": "q"}}, {"k": "7", "tags": ["x", "x"], "extra": 1}, {"k": 100, "s": "abcdef", "m": {}},
    {"s": "٣", "tags": ["x", ["y"]]}, {"s": 'say "it\'s"', "k": -0.25}, [1, 2], "text", 7, None, True, {"k": 0.3, "tags": [1, 1.0]}, {"m": {"a": None}}, {"k": 12345678.5}, {"s": "Name\n"},
]
SCHEMAS = [
    {"type": "object", "properties": {"k": {"type": "integer", "minimum": 2, "maximum": 50}, "s": {"type": "string", "minLength": 3, "maxLength": 5}}, "required": ["k", "s"], "additionalProperties": False},
    {"properties": {"k": {"type": ["number", "null"], "exclusiveMinimum": 0, "exclusiveMaximum": 100, "multipleOf": 0.1}, "tags": {"type": "array", "items": {"type": "string", "minLength": 2}, "minItems": 1, "maxItems": 2, "uniqueItems": True}}},
    {"properties": {"k": {"enum": [5, "7", None, True]}, "s": {"const": "ab"}, "m": {"type": "object", "additionalProperties": {"type": "integer"}, "minProperties": 1, "maxProperties": 1}}, "dependentRequired": {"k": ["s"]}},
    {"anyOf": [{"required": ["k"]}, {"type": "array"}], "oneOf": [{"type": "object"}, {"required": ["k"]}], "not": {"type": "string"}},
    {"if": {"required": ["s"]}, "then": {"properties": {"s": {"pattern": r"^\w+$"}}}, "else": {"properties": {"k": {"type": "string"}}}, "allOf": [{"$ref": "#/$defs/t"}], "$defs": {"t": {"properties": {"tags": {"contains": {"type": "string"}, "prefixItems": [{"type": "string"}], "items": False}}}}},
    {"patternProperties": {"^[km]": {"type": "object"}}, "additionalProperties": {"type": "string"}},
]


@pytest.mark.parametrize("number", range(len(SCHEMAS)))
def test_variant_as_interpreted(spark, number):
    schema = SCHEMAS[number]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(VALUES)], "id int, j string").withColumn("v", F.parse_json("j"))
    got = {r["id"]: [x.asDict() for x in r["violations"]] for r in validate_rows(df, Contract("t:T/v1", schema), "v").select("id", "violations").collect()}
    evaluator = Evaluator(load(schema))
    for k, v in enumerate(VALUES):
        want = [flat_record(r) for r in evaluator.violations(v)]
        key = lambda r: (r["json_path"], r["validator"], r["validator_value"])
        assert sorted(map(key, got[k])) == sorted(map(key, want)), v
        simple = lambda rs: sorted(r["message"] for r in rs if r["value"] and r["value"][0] not in "{[")
        assert simple(got[k]) == simple(want), v


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, "ab", 0.3, [1, 2], {"x": 1}, ("p",)), (2, None, 20.0, [], {"y": 99}, (None,)), (3, "it's", -1.25, None, None, None)], "id long, s string, d double, a array<int>, m map<string,int>, t struct<q:string>")
    schema = {"properties": {"s": {"minLength": 3}, "d": {"multipleOf": 0.1, "maximum": 10}, "a": {"minItems": 1, "items": {"maximum": 1}}, "m": {"additionalProperties": {"maximum": 5}}, "t": {"required": ["q"]}}, "required": ["s", "a"]}
    rows = violations(df, Contract("t:T/v1", schema), ["id"]).orderBy("id", "ordinal").collect()
    assert [(r.id, r.json_path, r.validator) for r in rows] == [(1, "/a/1", "maximum"), (1, "/s", "minLength"), (2, "", "required"), (2, "/a", "minItems"), (2, "/d", "maximum"), (2, "/m/y", "maximum"), (2, "/t", "required"), (3, "", "required"), (3, "/d", "multipleOf")]
    assert {r.message for r in rows if r.json_path == "/d"} == {"value 20 is greater than the maximum of 10", "value -1.25 is not a multiple of 0.1"}


def test_simple_bounds_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 1.5D as d", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = violations(df, Contract("t:T/v1", {"properties": {"d": {"minimum": 3, "maximum": 9}}}), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d), Or(LessThan(d,3.0),GreaterThan(d,9.0))]" in plan
    assert "ReadSchema: struct<id:bigint,d:double>" in plan
    assert found.count() == 5


@pytest.mark.parametrize(("pattern", "text", "hit"), [("^[A-Z]+$", "AB\n", True), (r"^\d$", "٣", True), ("[[]a", "[a", True), ("a$b", "a$b", False), (r"\$", "$", True), ("^x[&&]$", "x&", True)])
def test_patterns_mean_what_python_means(spark, pattern, text, hit):
    import re

    assert bool(re.search(pattern, text)) is hit
    assert spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(java_pattern(pattern))).count() == int(hit)


ODD_NAMES = ["k", 'a"b', "it's", "both\"'", "", "x.y", "q?", "sp ace", "\\", "ü"]
NUMBERS = st.one_of(st.integers(-(2**53) + 1, 2**53 - 1), st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: x != 0 or str(x) == "0.0"), st.sampled_from([9.3e18, 2.0**63, 1e20, 1e21, 1e30, 1e300, 5e-324, 1e-13, 0.3, 1e-7, 2.5e-5, 123456.789]))
SIMPLE = st.one_of(st.none(), st.booleans(), NUMBERS, st.text("ab{}\n \x1cé٣²_-", max_size=5))
DOCUMENTS = st.dictionaries(st.sampled_from(ODD_NAMES), st.one_of(SIMPLE, st.lists(SIMPLE, max_size=3)), max_size=3)
PATTERNS = ["^{.*}$", "a{2}", "a{,2}b", "{", "}", "x{1,b", r"^\s+$", r"\S", r"^\w*$", r"\W", "[{}]+", r"[\w{]$", r"[^\s]", "^.$", "[]a]", "[^]a]", r"a\x20?{"]
CHECKS = st.one_of(
    st.fixed_dictionaries({"type": st.sampled_from(["integer", "number", "string", "array", "null", "boolean"])}), st.fixed_dictionaries({"pattern": st.sampled_from(PATTERNS)}),
    st.fixed_dictionaries({"multipleOf": st.sampled_from([1, 7, 0.1, 0.25, 1e-13, 1e-19, 3.0, 1e300, 0.3])}), st.fixed_dictionaries({"minimum": NUMBERS}), st.fixed_dictionaries({"exclusiveMaximum": NUMBERS}), st.fixed_dictionaries({"const": SIMPLE}),
    st.fixed_dictionaries({"items": st.fixed_dictionaries({"type": st.just("integer")}), "uniqueItems": st.just(True), "minItems": st.integers(1, 2)}), st.fixed_dictionaries({"maxLength": st.integers(0, 3)}),
)
OBJECTS = st.fixed_dictionaries({"properties": st.dictionaries(st.sampled_from(ODD_NAMES), CHECKS, max_size=4), "required": st.lists(st.sampled_from(ODD_NAMES), unique=True, max_size=2)})


def test_columns_as_interpreted_over_random_schemas(spark):
    """One job for many schemas; every record's path, keyword, limit and value, and messages of values that aren't nested."""
    made = []

    @settings(max_examples=25, database=None, derandomize=True, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
    @given(OBJECTS, st.lists(DOCUMENTS, min_size=3, max_size=6))
    def collect(schema, documents):
        made.append((schema, documents))

    collect()
    texts = [json.dumps(d) for _, documents in made for d in documents]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string").withColumn("v", F.parse_json("j")).cache()
    at = 0
    for schema, documents in made:
        got = {r.id: r["violations"] for r in validate_rows(df.where((F.col("id") >= at) & (F.col("id") < at + len(documents))), Contract("t:T/v1", schema), "v").select("id", "violations").collect()}
        evaluator = Evaluator(load(schema))
        for k, d in enumerate(documents):
            want = [flat_record(r) for r in evaluator.violations(json.loads(json.dumps(d)))]
            whole_key = lambda r: (r["json_path"], r["validator"], r["validator_value"], r["value"] if r["value"][0] not in "[{" else "", r["message"] if r["value"][0] not in "[{" else "")
            assert sorted(whole_key(r.asDict()) for r in got[at + k]) == sorted(map(whole_key, want)), (schema, d)
        at += len(documents)
