import json
import math

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.sources.documents import decode_one, split_fence
from fathomline.sources.yaml12 import Rejected, decode

# text, value or code
CASES = [
    ("ship: Fram\nmasts: 3\nlength: 39.0\nafloat: false\nowner: ~", {"ship": "Fram", "masts": 3, "length": 39.0, "afloat": False, "owner": None}),
    ("- on\n- No\n- TRUE\n- NULL\n- .5\n- +7\n- 1_000\n- 0o17\n- 0xff\n- 6e2", ["on", "No", True, None, 0.5, 7, "1_000", 15, 255, 600.0]),
    ("launched: 1892-10-26\nlog: 1893-09-22 08:15:00\nat: 1896-08-13T20:00:00Z", {"launched": "1892-10-26", "log": "1893-09-22 08:15:00", "at": "1896-08-13T20:00:00Z"}),
    ("1895-04-08: north", {"1895-04-08": "north"}), ("seen: '<<'\n\"7\": text", {"seen": "<<", "7": "text"}), ("# only a remark", None), ("- |\n  two\n  lines\n", ["two\nlines\n"]),
    ("port: Oslo\ncall: 1\nport: Bergen", "yaml_duplicate_key"), ("deep:\n  - {x: 1, x: 1}", "yaml_duplicate_key"), ("first: &ref [1]\nthen: *ref", "yaml_alias"), ("lone: &mark 5", "yaml_alias"),
    ("hull: {<<: {planks: 9}}", "yaml_merge_key"), ("depth: !fathoms 12", "yaml_custom_tag"), ("depth: !!int '12'", "yaml_custom_tag"), ("2.5: half", "yaml_non_string_key"), ("null: x", "yaml_non_string_key"), ("? [a]\n: b", "yaml_non_string_key"),
    ("tons: 9007199254740993", "number_out_of_range"), ("tons: -.Inf", "number_out_of_range"), ("tons: [.nan]", "number_out_of_range"), ("drift: -0.0e3", "number_negative_zero"),
    ("crew: {cook: ", "yaml_parse_error"), ("a: b: c", "yaml_parse_error"), ("x\n--- \ny", "yaml_parse_error"), ("\tkey: 1", "yaml_parse_error"),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_decode(text, expected):
    if isinstance(expected, str):
        with pytest.raises(Rejected) as e:
            decode(text)
        assert e.value.code == expected
    else:
        assert decode(text) == expected


@pytest.mark.parametrize("opening", ["[", "{k: "])
@pytest.mark.parametrize(("levels", "fine"), [(2, True), (64, True), (66, False), (3000, False)])
def test_depth(opening, levels, fine):
    """Levels of collections; 64 are allowed."""
    text = opening * levels + "0" + {"[": "]", "{k: ": "}"}[opening] * levels
    if fine:
        decode(text)
        return
    with pytest.raises(Rejected) as e:
        decode(text)
    assert e.value.code == "yaml_limit"


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=20), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(whitelist_categories=("L", "N")), min_size=1, max_size=8), x, max_size=4), max_leaves=20)


@given(JSON)
@settings(max_examples=150, deadline=None)
def test_json_is_yaml(value):
    assert decode(json.dumps(value, ensure_ascii=False)) == value


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=100, deadline=None)
def test_floats(x):
    if x == 0 and math.copysign(1, x) < 0:
        return
    assert decode(yaml.safe_dump({"v": x}).replace("!!float ", "")) == {"v": x} or "e" in repr(x)


def test_fences():
    head, body = split_fence("--- \nlog: |\n  ---\n  calm\nmiles: 40\n---\t\n# A day\n---\n")
    assert decode(head) == {"log": "---\ncalm\n", "miles": 40} and body == "# A day\n---\n"
    assert split_fence(" ---\na: 1\n---") == (None, " ---\na: 1\n---") and split_fence("") == (None, "")
    assert split_fence("---\n---\nrest") == (None, "rest") and split_fence("---\r\nwind: 3\r\n---\r\nend") == ("wind: 3", "end")
    kind = lambda text: decode_one(text, "frontmatter-md")[4]
    assert kind("---\nwind: 3\n") == kind("---\n[3]\n---\n") == kind("---\njust words\n---\n") == "yaml_parse_error" and kind("---\nwind: 3\n---") is None
