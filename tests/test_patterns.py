"""Patterns written from their trees find what they found before, in Python and in Java."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fathomline.operators.interpret import Evaluator
from fathomline.operators.validate import Contract, violations
from fathomline.plans.columns import NotColumnar, java_pattern
from fathomline.plans.patterns import java, python
from fathomline.plans.schema_tree import load

ATOMS = ["a", "b", "ab", r"\d", r"\w", r"\s", r"\S", r"\W", r"\D", "[ab]", "[^a]", r"[\w-]", r"[^\s]", r"[\S]", "[a-c]", ".", "é", r"\.", r"\x61", r"é", r"\N{BULLET}", "{", "}", "[]a]", "[^]a]", r"[\]]", "(?#note)", "&&", "[a&&b]", "[[a]", "~", r"\b", r"\B", "^", "$", "(?=a)", "(?!b)", r"\n", "-", "/", "#", r"\t", "😀", "\n", "(?:)", "(?>a+)"]
TEXTS = ["", "a", "ab", "aab", "b", "é", "•", "1", "٣", "_", " ", "\n", "a\n", "ab\n\n", "{}", "[", "]", "a]", "-", "&&", "x~", "😀", "\x1c", "\x85", " ", "a.b", "A", "²", "#/", "abcabc", "a1 b2", "ß\t"]


def some_pattern(rng, depth=3):
    pieces = []
    for _ in range(rng.randint(1, 3)):
        piece = rng.choice(ATOMS)
        if depth and rng.random() < 0.4:
            piece = f"({rng.choice(['', '?:'])}{some_pattern(rng, depth - 1)}{rng.choice(['', '|' + some_pattern(rng, depth - 1)])})"
        pieces.append(piece + (rng.choice(["", "", "*", "+", "?", "{2}", "{0,2}", "{,1}", "+?", "*?", "++", "{1,}"]) if piece not in ("^", "$", r"\b", r"\B") and not piece.startswith("(?") else ""))
    return "".join(pieces)


def test_random_patterns_find_the_same(spark):
    rng = random.Random(3)
    patterns = []
    while len(patterns) < 250:
        p = some_pattern(rng)
        try:
            re.compile(p)
            patterns.append(p)
        except re.error:
            pass
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").coalesce(1)
    for k in range(0, len(patterns), 50):
        part = patterns[k : k + 50]
        found = texts.select("id", *[F.col("t").rlike(java_pattern(p)).alias(f"p{i}") for i, p in enumerate(part)]).collect()
        for r in found:
            for i, p in enumerate(part):
                want = bool(re.search(p, TEXTS[r.id]))
                assert r[f"p{i}"] is want and bool(python(p).search(TEXTS[r.id])) is want, (p, TEXTS[r.id])


@pytest.mark.parametrize("pattern", ["^(a+)+$", "^((a*)*)*$", "^(?:(a+)*)+b$", "((a|a)+)+$", "^(([a-z])+)+x$"])
def test_repeated_repetitions_end_soon(spark, pattern):
    text = "a" * 5000 + "!"
    start = time.perf_counter()
    assert python(pattern).search(text) is None and Evaluator(load({"pattern": pattern})).violations(text)
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert violations(df, Contract("t:T/v1", {"pattern": pattern}), ["id"], "t").count() == 1
    assert time.perf_counter() - start < 30
    for t in ("", "a", "aaa", "aab", "b", "aax", "aaaa!"):
        assert bool(python(pattern).search(t)) == bool(re.search(pattern, t))


def test_what_depends_on_groups_is_left_to_python():
    with pytest.raises(NotColumnar):
        java_pattern("(a)?(?(1)b|c)")
    assert python("^(a)?(?(1)b|c)$").search("ab") and not python("^(a)?(?(1)b|c)$").search("ac")
    assert "(a" not in java("(a)(b)")
