import json
import random
import struct

from fathomline.functions.canonical import canonical_json
from fathomline.plans.canonical_texts import canonical_text

SIGNS = ["a", "B", '"', "\\", "\n", "\0", "\x1f", "\x7f", "é", "😀", "\ue000", "\uffff", "\u2028", *"/!#,{}:[]<>(); 0"]
NUMBERS = [0.1, 0.1 + 0.2, 1e21, 1e20, 1e-7, 5e-324, 2.5e-310, -0.0, 123456.75, 2**53 - 1, 2**53, -(2**60), 10**40]


def expected(text: str | None) -> str | None:
    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    try:
        return None if text is None else canonical_json(json.loads(text, object_pairs_hook=unique)).encode().decode()
    except (TypeError, ValueError):
        return None


def value(r: random.Random, depth: int):
    text = lambda: "".join(r.choice(SIGNS) for _ in range(r.randrange(6)))
    match r.randrange(9 if depth else 6):
        case 0:
            return r.choice([None, True, False])
        case 1:
            return r.randrange(-(10**6), 10**6)
        case 2:
            return struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]
        case 3:
            return r.choice(NUMBERS)
        case 4 | 5:
            return text()
        case 6:
            return [value(r, depth - 1) for _ in range(r.randrange(4))]
    return {text(): value(r, depth - 1) for _ in range(r.randrange(5))}


def check(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_text("t").alias("c"))
    got = {r.i: r.c for r in made.collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, expected(t)) for t in texts]
    return made


def test_random_values(spark):
    r = random.Random(11)
    made = check(spark, [json.dumps(value(r, 4), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for _ in range(1500)])
    assert "python" not in made._jdf.queryExecution().executedPlan().toString().lower()


def test_what_has_no_canonical_form(spark):
    check(spark, [
        None, "", " ", "1 2", "1,2", "1]", "]", "}", "[1],[2]", "1],[2", "[1,]", '{"a"}', '"a":1', '{"a":1,"a":2}', '"a""b"', '"a\tb"', "01", "tru",
        "NaN", "1e999", "9007199254740993", "9007199254740993.0", "9223372036854775808.0", '"\\ud800"', '"\\\\ud800"', '{"\\udc00":1}', '"\\ud83d\\ude00"',
        "{}", "[]", "[[],{}]", '{"":{"":""}}', "-0", "-0.0", "1E5", "true",
    ])


def test_long_deep_and_wide(spark):
    check(spark, ["[" * 900 + "]" * 900, json.dumps({str(k): [k] for k in range(5000)}), json.dumps("x\n" * 200_000), json.dumps([1] * 50_000)])
    deep = spark.createDataFrame([("[" * 1001 + "]" * 1001,)], "t string").select(canonical_text("t").alias("c"))
    assert deep.first().c is None
