import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.functions.canonical import canonical_json, digest, same, spell_number
from fathomline.functions.vocab import message
from fathomline.operators.fields import SchemaFields
from fathomline.operators.interpret import Evaluator
from fathomline.plans.schema_tree import EnforcementUnsupported, SchemaInvalid, canonicalize, enforced, load

#: One schema for each keyword, by what it tells apart: values that pass, values that fail, and the keyword that says so.
PARCEL = {"$defs": {"code": {"$anchor": "code", "pattern": "^[A-Z]{2}-[0-9]+$"}, "box": {"properties": {"inside": {"$ref": "#/$defs/box"}, "kg": {"exclusiveMinimum": 0}}}}}
STRUCTURAL = [
    ("type", {"type": "integer"}, [7, -4.0, 9.3e18, 0], [0.5, "7", True, None]),
    ("type", {"type": ["array", "null"]}, [None, [], [[]]], [{}, "", 0, False]),
    ("format", {"format": "ipv4"}, ["999.1", "", 5], []),
    ("pattern", {**PARCEL, "$ref": "#code"}, ["NO-1", "NO-77\n", 12], ["no-1", "", "NO-"]),
    ("exclusiveMinimum", {**PARCEL, "$ref": "#/$defs/box"}, [{"inside": {"kg": 2}}, {"kg": "heavy"}, []], [{"kg": 0}, {"inside": {"inside": {"kg": -1.5}}}]),
    ("enum", {"enum": ["red", 3, {"w": [1]}, None]}, [3.0, {"w": [1.0]}, None], [False, "Red", [3], {"w": [True]}]),
    ("const", {"const": {"h": 2}}, [{"h": 2.0}], [{"h": 2, "w": 1}, 2]),
    ("multipleOf", {"multipleOf": 0.05}, [0.15, 1e30, -2, 0], [0.151, 1e-9]),
    ("multipleOf", {"multipleOf": 12}, [144, 0.0, 1.2e25], [13, 6.5]),
    ("uniqueItems", {"uniqueItems": True}, [["0", 0, False, None], [{"a": 1}, {"a": 2}], []], [[4, 4.0], [[1], [1.0]], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ("contains", {"contains": {"minimum": 100}}, [[1, 100], [500]], [[], [99]]),
    ("minContains", {"contains": {"type": "boolean"}, "minContains": 3}, [[True, False, True]], [[True, 1, False]]),
    ("maxContains", {"contains": {"type": "boolean"}, "maxContains": 1}, [[0, True]], [[True, False]]),
    ("minItems", {"minItems": 2}, [[0, 0], "x"], [[], [9]]),
    ("maxItems", {"maxItems": 1}, [[], [[1, 2]]], [[1, 2]]),
    ("anyOf", {"anyOf": [{"maxLength": 2}, {"pattern": "z$"}]}, ["ab", "buzz", 44], ["abc"]),
    ("oneOf", {"oneOf": [{"multipleOf": 4}, {"multipleOf": 6}]}, [4, 6, 8], [12, 5]),
    ("not", {"not": {"required": ["void"]}}, [{}, {"voids": 1}], [{"void": 0}, 3]),
    ("maxLength", {"if": {"pattern": "^s"}, "then": {"maxLength": 5}, "else": {"minLength": 0}}, ["short", "lengthy one"], ["spacious"]),
    ("minLength", {"if": {"pattern": "^s"}, "else": {"minLength": 4}}, ["s", "four"], ["two"]),
    ("maxLength", {"maxLength": 3}, ["\U0001f680\U0001f680\U0001f680", "ß"], ["\U0001f680abc"]),
    ("False schema", {"prefixItems": [{"type": "number"}, True], "items": False}, [[1], [2.5, "x"], []], [[1, 2, 3]]),
    ("additionalProperties", {"patternProperties": {"_id$": {"type": "integer"}}, "properties": {"note": {}}, "additionalProperties": False}, [{"user_id": 4, "note": 1}], [{"user": 4}]),
    ("propertyNames", {"propertyNames": {"pattern": "^[a-z]+$"}}, [{"key": 1}, {}], []),
    ("pattern", {"propertyNames": {"pattern": "^[a-z]+$"}}, [{"key": 1}], [{"Key": 1}]),
    ("dependentRequired", {"dependentRequired": {"card": ["expiry"]}}, [{"expiry": 1}, {"card": 1, "expiry": 2}], [{"card": 1}]),
    ("required", {"dependentSchemas": {"card": {"required": ["expiry"]}}}, [{}, {"card": 1, "expiry": 2}], [{"card": 1}]),
    ("minProperties", {"minProperties": 2}, [{"p": 1, "q": 2}, []], [{"p": 1}]),
    ("maxProperties", {"maxProperties": 1}, [{}, {"p": 1}], [{"p": 1, "q": 2}]),
    ("unevaluatedProperties", {"anyOf": [{"properties": {"lat": {"type": "number"}}}, True], "unevaluatedProperties": False}, [{"lat": 5}], [{"lat": 5, "lon": 6}]),
    ("unevaluatedItems", {"contains": {"const": "ok"}, "unevaluatedItems": {"type": "null"}}, [["ok", None]], [["ok", 0]]),
]


@pytest.mark.parametrize(("keyword", "schema", "good", "bad"), STRUCTURAL)
def test_structural(keyword, schema, good, bad):
    evaluator = Evaluator(load(schema))
    assert [evaluator.violations(v) for v in good] == [[]] * len(good)
    assert [[r["validator"] for r in evaluator.violations(v)] for v in bad] == [[keyword]] * len(bad)


def test_resources_are_given_never_fetched():
    port = {"$id": "tag:harbour,2020:port", "required": ["berths"]}
    fleet = {"items": {"properties": {"home": {"$ref": "tag:harbour,2020:port"}}}}
    evaluator = Evaluator(load(fleet, resources={"tag:harbour,2020:port": port}))
    assert evaluator.violations([{"home": {"berths": 2}}]) == [] and [r["path"] for r in evaluator.violations([{}, {"home": {}}])] == [["1", "home"]]
    twins = {"a": port, "b": {"$id": "tag:harbour,2020:port", "type": "object"}}
    for schema, resources, reason in ((fleet, {}, "reference"), ({"$ref": "http://localhost:1/x.json"}, {}, "reference"), (fleet, twins, "resource_identity")):
        with pytest.raises(SchemaInvalid) as e:
            load(schema, resources=resources)
        assert e.value.reason == reason


def test_what_fails_otherwise_is_a_compilation():
    deep: dict = {}
    for _ in range(5000):
        deep = {"items": deep}
    with pytest.raises(SchemaInvalid) as e:
        load(deep, strict=True)
    assert e.value.reason == "compilation"


REFUSED = [("pattern", p) for p in ({"pattern": "(?!x)(?<y>z)"}, {"pattern": "a**"}, {"items": {"patternProperties": {"(": True}}}, {"pattern": "ab" * 513}, {"pattern": r"(x|y)\2"}, {"pattern": r"\Ax"})]
REFUSED += [("syntax", "text"), ("syntax", None), ("dialect", {"type": ["string", "string"]}), ("dialect", {"maxLength": -1}), ("dialect", {"required": "all"}), ("dialect", {"anyOf": []}), ("dialect", {"multipleOf": 0}), ("dialect", {"not": [1]})]


@pytest.mark.parametrize(("reason", "schema"), REFUSED)
def test_refused_schemas(reason, schema):
    with pytest.raises(SchemaInvalid) as e:
        load(schema)
    assert e.value.reason == reason


def test_order_and_messages():
    schema = {"properties": {"port": {"enum": ["Oslo", 5, False]}, "hold": {"maxItems": 1}, "speed": {"exclusiveMaximum": 30.5}, "draft": {"multipleOf": 0.25}, "flag": {"maxLength": 2}}, "required": ["port", "imo", "crew"], "additionalProperties": False}
    value = {"hold": [1, 2], "speed": 9.3e18, "draft": 4.1, "flag": "NOR", "port": {"name": 3.0}, "x": None}
    found = Evaluator(load(schema)).violations(value)
    said = [("/".join(r["path"]), r["validator"], r["message"]) for r in found]
    assert said == [
        ("", "additionalProperties", "object has properties that are not allowed"), ("", "required", "required property ['port', 'imo', 'crew'] is missing"), ("", "required", "required property ['port', 'imo', 'crew'] is missing"),
        ("draft", "multipleOf", "value 4.1 is not a multiple of 0.25"), ("flag", "maxLength", "string is longer than the maximum length of 2"), ("hold", "maxItems", "array is longer than the maximum of 1 items"),
        ("port", "enum", "value {'name': 3} is not one of ['Oslo', 5, False]"), ("speed", "exclusiveMaximum", "value 9300000000000000000 is not less than 30.5"),
    ]
    assert message("oneOf", [{"minimum": 4.0}], [True]) == "value [True] failed oneOf constraint [{'minimum': 4}]" or message("oneOf", [{"minimum": 4.0}], [True]) == "value [True] failed oneOf constraint {'minimum': 4}"
    assert message("type", ["array", "null"], -7.0) == "value -7 is not of type 'array', 'null'"


def test_array_places_sort_as_text():
    found = Evaluator(load({"items": {"type": "string"}})).violations([1] * 11)
    assert [r["path"][0] for r in found] == sorted(map(str, range(11)))


def test_canonicalize():
    limits = {"minimum": -(2**53) + 1, "maximum": 2**53 - 1}
    before = {
        "required": ["sku", "name"], "propertyNames": {"type": "string"},
        "properties": {"oneOf": {"oneOf": [{"$ref": "#/$defs/x"}, {"type": "null"}]}, "stock": {"type": "integer", **limits}, "floor": {"minimum": 2**53 - 1}, "two": {"oneOf": [{"type": "null"}, {"type": "null"}]}, "keys": {"propertyNames": {"minLength": 1}}},
        "$defs": {"x": {"items": {"required": ["z", "y"], "maximum": 2**53 - 1}, "examples": [{"required": ["q", "p"]}]}},
    }
    after = canonicalize(before)
    assert after["required"] == ["name", "sku"] and "propertyNames" not in after and before["required"] == ["sku", "name"]
    assert after["properties"] == {"oneOf": {"anyOf": [{"$ref": "#/$defs/x"}, {"type": "null"}]}, "stock": {"type": "integer"}, "floor": {"minimum": 2**53 - 1}, "two": before["properties"]["two"], "keys": {"propertyNames": {"minLength": 1}}}
    assert after["$defs"]["x"] == {"items": {"required": ["y", "z"]}, "examples": [{"required": ["q", "p"]}]} and canonicalize(after) == after


def test_enforced():
    schema = {"properties": {"a": {"properties": {"properties": {"type": "string"}}}, "free": {"type": "object"}, "open": {"properties": {"x": {}}, "additionalProperties": True}}}
    closed = enforced(schema)
    assert closed["additionalProperties"] is False and closed["properties"]["a"]["additionalProperties"] is False
    assert "additionalProperties" not in closed["properties"]["free"] and closed["properties"]["open"]["additionalProperties"] is True
    assert "additionalProperties" not in schema
    for bad in ({"allOf": [{"properties": {"a": {}}}]}, {"if": {"properties": {"a": {}}}}, {"dependentSchemas": {"a": {"properties": {"b": {}}}}}, {"not": {"items": {"properties": {"a": {}}}}}):
        with pytest.raises(EnforcementUnsupported):
            enforced(bad)


def test_canonical_json():
    assert canonical_json({"zoo": [True, None], "Ärger": {"b": "\n", "a": []}, "_": "é\u2028"}) == '{"_":"é\u2028","zoo":[true,null],"Ärger":{"a":[],"b":"\\n"}}'
    assert canonical_json({"\ufb01": 0, "\U00010300": 1}) == '{"\U00010300":1,"\ufb01":0}'  # by UTF-16 units a surrogate comes first
    spelled = {4.0: "4", 2.5e20: "250000000000000000000", 3e22: "3e+22", 7e-6: "0.000007", 7.25e-8: "7.25e-8", -0.125: "-0.125", 1.7976931348623157e308: "1.7976931348623157e+308", 5e-324: "5e-324"}
    assert {x: spell_number(x) for x in spelled} == spelled
    assert digest([False]) != digest([0]) and digest({"x": 1, "y": 2.0}) == digest({"y": 2, "x": 1.0})
    for bad in (-(2**53), math.nan, b"x", [math.inf]):
        with pytest.raises(TypeError):
            canonical_json(bad)


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=300, deadline=None)
def test_spelling_reads_back(x):
    assert float(spell_number(x)) == x


def test_same():
    assert same({"a": [1]}, {"a": [1.0]}) and not same(1, True) and not same([1], [1, 2]) and not same("1", 1)


def test_fields():
    part = {"properties": {"maker": {"type": ["null", "string"]}, "parts": {"type": "array", "items": {"$ref": "#/$defs/part"}}, "spare": {"anyOf": [{"$ref": "#/$defs/part"}, {"type": "null"}]}}, "required": ["maker"], "description": "any part", "x-fathom": {"group": "hull"}}
    schema = {
        "$defs": {"part": part},
        "properties": {"keel~/1": {"$ref": "#/$defs/part", "description": "the keel"}, "crew": {"type": ["integer", "string"]}, "rig": {"anyOf": [{"type": "null"}, {"type": "string", "enum": ["sloop", "ketch"]}]}, "void": {"type": "null"}, "odd": {"anyOf": [{"type": "null"}, {"type": "null"}]}, "lost": {"$ref": "#/$defs/none"}, "no": True},
        "required": ["crew"],
    }
    found = {f.pointer: f for f in SchemaFields(schema).all()}
    keel = "/properties/keel~0~11"
    assert list(found) == [keel, f"{keel}/properties/maker", f"{keel}/properties/parts", f"{keel}/properties/spare", "/properties/crew", "/properties/rig", "/properties/void", "/properties/odd", "/properties/lost"]
    assert {p.rpartition("/")[2]: f.json_type for p, f in found.items()} == {"keel~0~11": None, "maker": "string", "parts": "array", "spare": None, "crew": None, "rig": "string", "void": "null", "odd": None, "lost": None}
    assert found[keel].description == "the keel" and found[f"{keel}/properties/maker"].required and not found[keel].required and found["/properties/crew"].required
    assert found["/properties/rig"].enum == ["sloop", "ketch"] and found["/properties/crew"].enum is None
    assert [f.pointer for f in SchemaFields(schema).having("group", "hull")] == [keel] and len(list(SchemaFields(schema).all(follow=False))) == 6
    assert SchemaFields(schema).at("/properties/rig").name == "rig"
    with pytest.raises(ValueError):
        SchemaFields(schema).at("/properties/sail")
