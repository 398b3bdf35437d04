"""Jaccard join, embeddings, decontamination, WARC, components and the pipeline against brute-force versions."""

import collections
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import warc
from fathomline.llm._components import Union, components
from fathomline.llm._words import LETTERS, shingles, words
from fathomline.llm.decontaminate import decontaminate
from fathomline.llm.embedding_dedup import Plan as VectorPlan
from fathomline.llm.embedding_dedup import embedding_dedup
from fathomline.llm.jaccard_join import Plan, jaccard_join

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOC = "doc_id long, text string"


def linked(ids, near):
    """id: (links, component) by brute force."""
    up, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if near(a, b):
            n[a] += 1
            n[b] += 1
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (n[i], find(i)) for i in ids}


# ---- parts --------------------------------------------------------------------------------------------------------


def test_words_and_shingles():
    w = words(["Ab cd", "", "É x", "ab CD"], LETTERS)
    assert w.doc.tolist() == [0, 0, 2, 2, 3, 3] and w.hash[0] == w.hash[4] and w.hash[1] == w.hash[5] and len(set(w.hash.tolist())) == 4
    h, at = shingles(w, 2)
    assert at.tolist() == [0, 2, 4] and h[0] == h[2] != h[1]
    assert words(["é"], LETTERS).hash[0] == words(["É"], LETTERS).hash[0]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(5, 3), (3, 5), (9, 7), (7, 1), (2, 2)]])
def test_components(spark, links):
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    sets = Union(60)
    for a, b in links:
        sets.join(a, b)
    assert got == {i: sets.find(i) for i in {x for p in links for x in p}}


# ---- Jaccard ------------------------------------------------------------------------------------------------------


def sets_of(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_jaccard(docs):
    s = {i: sets_of(t) for i, t in docs}
    return linked(sorted(s), lambda a, b: bool(s[a] and s[b]) and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8 - 1e-12)


def group(rng, n, base, changes):
    for _ in range(n):
        t = list(base)
        for _ in range(rng.integers(0, changes + 1)):
            t[int(rng.integers(len(t)))] = f"w{rng.integers(10**6)}"
        yield " ".join(t)


def test_jaccard_join(spark):
    rng = np.random.default_rng(2)
    new = lambda n: [f"v{x}" for x in rng.integers(0, 10**5, n)]
    passage = new(40)
    texts = list(group(rng, 60, new(200), 4)) + list(group(rng, 25, new(120), 5)) + [" ".join(passage + new(60)) for _ in range(60)] + [" ".join(new(80))] * 5
    texts += [None, "", "  \n", "one two", "One  TWO", "one two three", "x " * 30_000] + [" ".join(new(50)) for _ in range(100)]
    docs = [(k * 3, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs] + [(None, texts[0], None)], DOC + ", class_id string")
    plan = Plan(small=16, block=32, exact_sets=16)
    rows = jaccard_join(df, plan=plan).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in rows} == brute_jaccard(docs) and len(rows) == len(docs)
    assert {r.doc_id for r in rows if r.kept} == {r.component_id for r in rows}
    assert jaccard_join(df.limit(0)).count() == 0


def test_jaccard_of_repeated_ids_and_ties(spark):
    ten = [f"t{k}" for k in range(13)]  # nine shingles
    docs = [(5, "a b c d e f"), (5, "other words that stand here alone"), (7, "A b c d e f"), (9, "other words that stand here alone"), (9, "other words that stand here alone"), (5, None)]
    docs += [(20, " ".join(ten[:12])), (21, " ".join(ten[:12] + ["x", "y"])), (22, " ".join(ten[:12] + ["x", "y", "z"]))]  # 8 shingles, 10: exactly 0.8; 11
    rows = jaccard_join(spark.createDataFrame(docs, DOC)).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in rows) == [(5, 0, 5), (5, 1, 5), (5, 2, 5), (7, 1, 5), (9, 2, 5), (9, 2, 5), (20, 1, 20), (21, 2, 20), (22, 1, 20)]
    assert sorted(r.doc_id for r in rows if r.kept) == [5, 5, 5, 20] and len({r.version for r in rows if r.doc_id == 5}) == 3


@here
def test_jaccard_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = jaccard_join(docs).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in rows} == brute_jaccard([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def generated(spark, since=-1):
    """Rows that explode(array_distinct(...)) made in executions after the one numbered since, and the last one's number."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    done = store.executionsList()
    for k in range(done.size()):
        number = done.apply(k).executionId()
        last = max(last, number)
        if number <= since:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "Generate" and "array_distinct" in node.desc():
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows, last


def test_jaccard_splits_a_group_in_linear_work(spark):
    """A bucket of near copies is split once for each of its sets: at most `split` rows a set and sampled coordinate."""
    rng, plan = np.random.default_rng(3), Plan(small=16, block=64)
    base = [f"b{k}" for k in range(400)]
    made, (_, last) = {}, generated(spark)
    for n in (150, 300):
        docs = list(enumerate(group(rng, n, base, 2)))
        texts = len({t for _, t in docs})
        rows = jaccard_join(spark.createDataFrame(docs, DOC), plan=plan).collect()
        assert {r.component_id for r in rows} == {0}
        made[n], last = generated(spark, last)
        assert 0 < made[n] <= texts * plan.runs * plan.chosen * plan.split
    assert made[300] <= 2.2 * made[150]


# ---- embeddings ---------------------------------------------------------------------------------------------------


def brute_cosine(rows, threshold=0.95):
    dim = collections.Counter(len(v) for _, v in rows if v).most_common(1)[0][0]
    ok = {i: np.array(v, float) for i, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    return linked(sorted(i for i, _ in rows), lambda a, b: a in unit and b in unit and float(unit[a] @ unit[b]) >= threshold)


@pytest.mark.parametrize("plan", [VectorPlan(), VectorPlan(residents=16, queries=24, sample=100)])
def test_embeddings(spark, plan):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    near = np.concatenate([base[k] + rng.normal(scale=0.05 * np.linalg.norm(base[k]) / 4, size=(n, 16)) for k, n in ((0, 40), (1, 7), (2, 2))])
    v = [x.astype(np.float32).tolist() for x in np.concatenate([base, near, base[:3], base[3:5] * 7])]
    rows = list(enumerate(v)) + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] * 16), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [1e38] * 16), (908, [1e-38] * 16)]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows] + [(None, v[0], "z")], "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, plan=plan).collect()}
    want = brute_cosine(rows)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert got == want
    assert embedding_dedup(df.limit(0)).count() == 0
    assert embedding_dedup(df.where("vec_id = 902")).collect()[0].n_links == 0


def spectrum(rng, n, dim, strong):
    """Vectors near one of a few centres, with noise of that many strong directions (0: all alike, -1: falling as 1/k)."""
    scale = np.ones(dim) if not strong else 1 / np.arange(1, dim + 1) if strong < 0 else np.r_[np.ones(strong), np.full(dim - strong, 0.05)]
    scale = scale / np.linalg.norm(scale)
    centres = rng.normal(size=(6, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    spread = np.where(rng.random(n) < 0.5, 0.24, 0.9)[:, None]
    return centres[rng.integers(6, size=n)] + spread * rng.normal(size=(n, dim)) * scale


@pytest.mark.parametrize(("dim", "strong"), [(64, 0), (64, -1), (64, 2), (64, 3), (64, 4), (64, 6), (8, 0), (1024, 3)])
def test_embeddings_lose_no_link(spark, dim, strong):
    rng = np.random.default_rng(dim + strong)
    v = spectrum(rng, 1500, dim, strong)
    v = np.concatenate([v, v[:3] * 2])
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert np.abs(cosine - 0.95).min() > 1e-12
    near = cosine >= 0.95
    want = near.sum(axis=1) - 1
    assert want.sum() > 2000
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df, plan=VectorPlan(residents=256, queries=512)).collect()}
    assert [got[k] for k in range(len(v))] == want.tolist()


def test_embeddings_count_balls_of_near_copies(spark):
    """Groups tight enough to be balls, beside one another, with copies, stray members and vectors that link with a part of one."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3, 64))
    base[2] = base[0] + rng.normal(size=64) * 0.2
    groups = [base[k] + rng.normal(size=(n, 64)) * s for k, n, s in ((0, 400, 0.12), (1, 60, 0.05), (2, 200, 0.1), (0, 80, 0.2), (1, 30, 0.25))]
    v = np.concatenate([*groups, rng.normal(size=(300, 64)), groups[0][:20], groups[1][:3] * 4])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = linked(range(len(v)), lambda a, b: near[a, b])
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    for plan in (VectorPlan(), VectorPlan(residents=32, queries=64), VectorPlan(least_ball=10**9)):
        rows = embedding_dedup(df, plan=plan).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want


def test_embeddings_at_the_very_threshold(spark):
    rows = [(0, [3.0, 4.0, 0.0, 0.0]), (1, [6.0, 8.0, 0.0, 0.0]), (2, [4.0, 3.0, 0.0, 0.0]), (3, [0.0, 0.0, 3.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = 0.6 * 0.8 + 0.8 * 0.6
    for threshold, links in ((exact, [2, 2, 2, 0]), (np.nextafter(exact, 2), [1, 1, 0, 0])):
        got = {r.vec_id: r.n_links for r in embedding_dedup(df, plan=VectorPlan(threshold=threshold)).collect()}
        assert [got[k] for k in range(4)] == links


# ---- decontamination ----------------------------------------------------------------------------------------------

ITEM = "Tom has 3 apples and gives 2 apples to Mary so how many apples does Tom have now in the red box of 5 km"


def test_decontamination(spark):
    other = "we saw that Ann has 9 apples and gives 4 apples to Bob so how many apples does Ann have now in the red box of 8 miles"
    docs = [(1, f"Before it. {ITEM} and after"), (2, other.replace("Ann", "Lisa")), (3, other.replace("Ann", "Lisa", 1).replace("Ann", "Kate").replace("Bob", "Kate")), (4, None), (5, ""), (6, "word " * 50_000), (7, ITEM.upper()), (8, "so how many apples does it"), (9, "x pq rs tu y"), (10, " ".join(ITEM.split()[:14]))]
    items = [(70, ITEM), (71, None), (72, ""), (73, "pq rs tu"), (74, ITEM)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, ITEM, 1), (1, "again", 1)], DOC + ", item_id int")
    bench = spark.createDataFrame(items + [(None, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate(df, bench).collect()}
    assert set(got) == {(i, k) for i in (1, 2, 7, 10) for k in (70, 74)} | {(9, 73)}
    assert got[1, 70].exact and not got[2, 70].exact and got[7, 70].exact
    assert decontaminate(df.limit(0), bench).count() == 0 and decontaminate(df, bench.limit(0)).count() == 0


def pairs(spark, docs, items):
    made = [spark.createDataFrame(list(enumerate(t)), f"{i} long, text string") for i, t in (("doc_id", docs), ("item_id", items))]
    return {(r.doc_id, r.item_id) for r in decontaminate(*made).collect()}


def test_decontamination_values_of_several_words(spark):
    item = "a shop where {} works sells {} apples for {} dollars and then {} buys {} pears with the {} coins left over"
    docs = ["so " + item.format("Mary Ann", "1,250", "2.5", "Mary Ann", "twenty-five", "one hundred and five"), "a shop where Tom works sells 5 plums and then has 8 coins left over"]
    assert pairs(spark, docs, [item.format("Alice", "3", "5", "Alice", "25", "105"), "Tom has 3 apples"]) == {(0, 0)}
    assert pairs(spark, ["then Mary Ann bought 1,250 ripe red apples there"], ["Alice bought 3 ripe red apples", "bought 3 green apples"]) == {(0, 0)}


def test_decontamination_numbers_that_collide(spark):
    item = "a box holds {} red and {} blue marbles so how many must you draw to hold {} of the same colour"
    docs = [item.format(4, 4, 7), item.format(7, 9, 8)]
    assert pairs(spark, docs, [item.format(3, 5, 2), item.format(5, 5, 2)]) == {(0, 0), (1, 0), (0, 1), (1, 1)}


def test_decontamination_windows_of_few_words(spark):
    sums = "{} km plus {} m plus {} cm plus {} mm plus {} m"
    docs = [f"sum {sums} in all".format(*range(3, 8)), f"we see {sums} then".format(*range(3, 8))]
    assert pairs(spark, docs, [f"work out the sum {sums} in all".format(*range(20, 25))]) == {(0, 0)}


def test_decontamination_names_that_clash_in_a_part(spark):
    from fathomline.llm.decontaminate import _passage, _runs

    middle = " ".join(f"word{chr(97 + k)}" for k in range(20))
    item = f"then Tom gave {middle} and so 3 men who saw Tom left 5 boxes at noon"
    docs = [item.replace("Tom", "Lisa"), item.replace("Tom", "Lisa", 1).replace("Tom", "Kate"), "then Lisa gave Kate and so Kate left"]
    got = {r.doc_id: r.words for r in decontaminate(spark.createDataFrame(list(enumerate(docs)), DOC), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert set(got) == {0, 1} and got[0] == len(item.split()) > got[1] > 22  # beyond the words between the names
    made = [{"place": k, "begin": k, "end": k + 8, "names": [(1, 5 if k < 3 else 6)] if k < 3 or k > 8 else [], "numbers": []} for k in range(12)]
    assert [[w["place"] for w in r] for r in _runs(made)] == [list(range(9)), list(range(3, 12))]
    found = lambda windows, total: _passage(windows, total, 13, 0.5, 0.25)
    assert found(made, 12) == (16, 0.75) and found(made, 30) is None and found(made[:9], 30) == (16, 0.3)


def test_decontamination_numbers_that_come_again(spark):
    """Of 120 questions with three or four numbers, each named three times, in text of its own: with other numbers put in alike all are
    found; with a number of its own in each place none is; two places that stray of nine or more are borne."""
    rng = np.random.default_rng(4)
    things = [f"{a}{b}" for a in ("lamp", "pear", "stone", "bell", "rope", "coin") for b in ("fold", "wick", "mark", "hold", "stem")]

    def question(k, put):
        rows, picked = 3 + k % 2, [f"{t}{chr(97 + k // 26)}{chr(97 + k % 26)}" for t in things]  # no two questions have a thing in common
        said = [f"there are {{{r}}} {picked[3 * r]} in the {picked[3 * r + 1]} and {picked[3 * r + 2]}" for r in range(rows)]
        again = [f"who moves {{{r}}} of the {picked[15 + r]} to a {picked[20 + r]}" for r in range(rows)]
        last = [f"what if {{{r}}} more {picked[25 + r]} come back" for r in range(rows)]
        return re.sub(r"\{(\d)\}", lambda m: str(put(int(m[1]))), " then ".join([*said, *again, *last]))

    items = [question(k, lambda r: 10 + r) for k in range(120)]
    alike = [f"note {k} says " + question(k, rng.integers(100, 900, 4).tolist().__getitem__) + " or so" for k in range(120)]
    astray = [question(k, lambda _: int(rng.integers(100, 9999))) for k in range(120)]
    few = []
    for k in range(120):
        seen = [0]

        def put(r):
            seen[0] += 1
            return 555 + seen[0] if seen[0] in (2, 6) else 70 + r

        few.append(question(k, put))
    got = pairs(spark, alike + astray + few, items)
    assert got == {(k, k) for k in range(120)} | {(240 + k, k) for k in range(120)}


def test_decontamination_verbatim_beside_numbers_astray(spark):
    head = " ".join(f"word{chr(97 + k)}" for k in range(16))
    table = " ".join(f"row of {{}} and {chr(97 + k)}x {{}}" for k in range(8))
    docs = [f"{head} {table}".format(*range(100, 116)), f"some {table}".format(*range(100, 116))]
    assert pairs(spark, docs, [f"{head} {table}".format(*[5, 6] * 8)]) == {(0, 0)}


def test_decontamination_shapes_of_values(spark):
    item = "the road from the farm to the old mill is {} long and the toll there costs {} for each cart that passes"
    docs = [item.format("8 miles", "$3"), item.format("5km", "four dollars"), item.format("2.5 km", "7 %").upper(), item.format("long", "nothing")]
    assert pairs(spark, docs, [item.format("5 km", "12 euros")]) == {(0, 0), (1, 0), (2, 0)}
    assert pairs(spark, ["what is 17 + 25", "what is 5"], ["What is 17 + 25?"]) == {(0, 0)}


def test_decontamination_passages_have_no_gaps(spark):
    word = lambda k: f"w{chr(97 + k // 26)}{chr(97 + k % 26)}"
    item = " ".join(word(k) for k in range(120))
    own = " ".join(f"q{chr(97 + k)}" for k in range(20))
    eight = lambda a: " ".join(word(k) for k in range(a, a + 8))
    docs = [f"{eight(0)} {own} {eight(28)}", f"{own} " + " ".join(word(k) for k in range(40, 53))]
    assert pairs(spark, docs, [item]) == {(1, 0)}
    two = spark.createDataFrame([(0, eight(0)), (0, "x x x x x x x x " + eight(8))], DOC)
    assert decontaminate(two, spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 0


@here
def test_decontamination_finds_every_item_with_other_values(spark):
    """Each benchmark item with its numbers and known names changed, in text of its own, pairs with the item."""
    from fathomline.llm.decontaminate import NAMES

    rng = np.random.default_rng(8)
    names = {n.capitalize(): m.capitalize() for n, m in zip(NAMES, np.roll(NAMES, 7), strict=True)}
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    change = lambda t: re.sub(r"\d+|[A-Z][a-z]+", lambda m: names.get(m[0], m[0]) if m[0].isalpha() else str(rng.integers(2, 5000)), t)
    docs = [(i, f"some words of {i} before it . {change(t)} . and after it") for i, t in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i, _ in items} <= got


@here
def test_decontamination_on_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = collections.defaultdict(set)
    for r in bench.collect():
        w = tokens(r.text)
        for k in range(len(w) - 12):
            runs[tuple(w[k : k + 13])].add(r.item_id)
    want = {(r.doc_id, b) for r in docs.collect() for w in [tokens(r.text)] for k in range(len(w) - 12) for b in runs.get(tuple(w[k : k + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()} == want


# ---- WARC ---------------------------------------------------------------------------------------------------------


def archive(n=12):
    return [warc._page_record(k, f"http://x/{k} y\r\nz", (b"<p>%d</p>" % k) * 200, None, False, "1970-01-01T00:00:00Z") for k in range(n)]


def found(data):
    out = list(warc.salvage(data))
    return [int(r.fields["x-page-id"]) for r in out if not r.reason], [(r.start, r.end, r.reason) for r in out if r.reason]


def test_salvage():
    import zlib

    records = archive()
    whole = b"".join(records)
    assert found(whole) == (list(range(12)), []) and found(b"") == ([], [])
    at = [0, *itertools.accumulate(map(len, records))]
    broken = bytearray(whole)
    broken[at[4] + 40] ^= 255
    assert found(bytes(broken)) == ([k for k in range(12) if k != 4], [(at[4], at[5], "damaged member")])
    cut = whole[: at[7] + 5] + whole[at[7] + 60 :]
    assert found(cut)[0] == [k for k in range(12) if k != 7]
    assert found(whole[:-10])[0] == list(range(11)) and found(b"junk" + whole)[1] == [(0, 4, "no version line")]
    plain = bytearray(b"".join(zlib.decompress(r, 31) for r in records))
    plain[plain.find(b"X-Page-ID: 3") + 500] ^= 1
    ids, gaps = found(bytes(plain))
    assert ids == [k for k in range(12) if k != 3] and gaps[0][2] == "block digest differs"
    assert found(b"".join(records[:2]) + bytes(plain))[0] == [0, 1, *ids]
    assert found(b"".join(records) + b"\x1f\x8b\x08" * 50)[0] == list(range(12))


def test_salvage_inside_members():
    import zlib

    def member(plain):
        squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
        return squeeze.compress(plain) + squeeze.flush()

    noise = np.random.default_rng(1)
    pages = [warc._page_record(k, f"http://x/{k}", noise.bytes(3000), None, False, "1970-01-01T00:00:00Z") for k in range(6)]
    plain = [zlib.decompress(r, 31) for r in pages]
    bad = bytearray(b"".join(plain))
    bad[len(plain[0]) + len(plain[1]) + 1500] ^= 1
    one = member(bytes(bad))
    assert found(one) == ([0, 1, 3, 4, 5], [(0, len(one), "block digest differs")])
    assert found(pages[0] + one + pages[1])[0] == [0, 0, 1, 3, 4, 5, 1]
    whole = member(b"".join(plain))
    ids, gaps = found(whole[: len(whole) * 3 // 4] + pages[2])
    assert ids == [0, 1, 2, 3, 2] and len(gaps) == 1
    ids, gaps = found(whole[: len(whole) * 3 // 4])
    assert ids == [0, 1, 2, 3] and [g[1:] for g in gaps] == [(len(whole) * 3 // 4, "cut member")]
    broken = bytearray(whole)
    broken[-6] ^= 255
    assert found(bytes(broken) + pages[2])[0] == [0, 1, 2, 3, 4, 5, 2]


def test_salvage_of_a_source_that_holds_little(tmp_path):
    whole = b"".join(archive(40))
    at = len(whole) // 2
    broken = whole[:at] + b"?" * 90 + whole[at + 70 :]
    plain = [list(warc.salvage(broken)), list(warc.salvage(warc.Source(__import__("io").BytesIO(broken), len(broken), hold=64)))]
    assert plain[0] == plain[1] and sum(not r.reason for r in plain[0]) >= 38


def test_warc_round_trip(spark, tmp_path):
    big = "<p>same</p>" * 200
    pages = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "u2", "small"), (4, "u4", "small"), (6, "u6", None), (7, "u7", ""), (8, "é ü", "é" * 700), (8, "u8", "x" * 2000), (None, "n", big), (9, "u9", "y" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(warc.plan_records(df, "page_id", "url", "html"), folder, roll_bytes=1500)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    back = warc.read_warc(spark, f"{folder}/archives").where("record_type in ('response', 'revisit')").collect()
    kind = collections.Counter((r.fields.get("x-page-id"), r.record_type, r.refers_to) for r in back)
    assert kind[("1", "revisit", "<urn:x-page:5>")] == kind[("3", "revisit", "<urn:x-page:5>")] == kind[("5", "response", None)] == kind[(None, "revisit", "<urn:x-page:5>")] == 1
    assert kind[("2", "response", None)] == kind[("4", "response", None)] == 1 and kind[("8", "response", None)] == 2
    assert sorted(bytes(r.payload).decode() for r in back if r.record_type == "response") == sorted([big, "small", "small", "", "", "é" * 700, "x" * 2000, "y" * 300_000])
    assert {r.payload_bytes for r in back if r.record_type == "revisit"} == {len(big)} and len({r.payload_digest for r in back if r.fields.get("x-page-id") in ("1", "3", "5")}) == 1
    streamed = warc.read_warc(spark, f"{folder}/archives", stream=True).where("record_type in ('response', 'revisit')").collect()
    key = lambda r: (r.start, r.end, r.record_id, r.record_type, r.refers_to, bytes(r.payload), r.payload_digest, sorted(r.fields.items()))
    assert sorted(map(key, streamed)) == sorted(map(key, back))
    empty = f"file://{tmp_path}/e"
    assert warc.write_warc(warc.plan_records(df.limit(0), "page_id", "url", "html"), empty).count() == 0
    assert warc.read_warc(spark, f"{empty}/archives").count() == 0


# ---- pipeline -----------------------------------------------------------------------------------------------------


@here
def test_pipeline(spark):
    import corpus_pipeline as cp
    from test_text_ops import brute_lines

    from fathomline.llm import toxicity as tox

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = tox.learnt(spark, SF, docs)
    odds = tox.Matcher(model.weights, model.exceptions)
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.intercept + float(np.dot(model.slopes, odds.features(r.text or ""))) < 0]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    kept = brute_jaccard(rows)
    rows = [(i, t) for i, t in rows if kept[i][1] == i]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [tokens(r.text)] for k in range(len(w) - 12)}
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + 13]) in runs for w in [tokens(t)] for k in range(len(w) - 12))]
    import hashlib

    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.decoded_sha256 for r in cp.run(spark, SF).collect()} == want


@here
def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated ids, empty and long texts, a clashing column, columns that are missing, no rows."""
    import corpus_pipeline as cp

    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    words = [f"plain{k} words{k} stand{k}" for k in range(400)]
    own = [(1, " ".join(words[:60]), "en", "s", 5), (1, " ".join(words[100:160]), None, None, None), (2, " ".join(words[:60]), "en", "s", 5), (None, "no id here", None, None, None), (3, None, None, "s", 0), (4, "", "de", None, 0), (5, " ".join(words) * 40, "en", "s", 1), (None, None, None, None, None)]
    rows = spark.createDataFrame([(*r, "x", r[0]) for r in own], "doc_id long, text string, lang string, source string, n_chars long, Score string, version long")
    for name, docs in (("full", rows), ("bare", rows.select("text", "doc_id")), ("none", rows.limit(0))):
        at = f"{tmp_path}/{name}"
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(f"{at}/{t}.parquet")
        kept = cp.run(spark, at).collect()
        want = [] if name == "none" else [1, 1, 3, 4, 5, None, None]
        assert sorted((r.doc_id for r in kept), key=lambda i: (i is None, i)) == want
        assert all(r.n_tokens == len(r.ids) for r in kept)
        if name == "bare":
            assert {(r.lang, r.source) for r in kept} == {(None, None)}


def most_python(plan):
    """The most Python nodes that a stage of a physical plan runs at once; each takes a worker of its own in every task."""
    most = 0

    def here(node):
        nonlocal most
        name, kids = node.nodeName(), node.children()
        if name.startswith("AdaptiveSparkPlan"):
            return here(node.initialPlan())
        n = sum(here(kids.apply(k)) for k in range(kids.size())) + ("Python" in name or "InArrow" in name)
        most = max(most, n)
        return 0 if "Exchange" in name else n

    here(plan)
    return most


@here
def test_pipeline_has_one_worker_a_task(spark, monkeypatch):
    """Workers stay for the stages that follow, so a stage with two of them a task doubles the memory of all."""
    import corpus_pipeline as cp
    from fathomline.llm import _components, _work, decontaminate, jaccard_join, line_dedup, toxicity

    seen = {}

    def cut(df, name, rows=None):
        seen[name] = max(seen.get(name, 0), most_python(df._jdf.queryExecution().executedPlan()))
        return _work.cut(df, name, rows)

    for module in (cp, _components, decontaminate, jaccard_join, line_dedup, toxicity):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", cut)
    seen["tokens"] = most_python(cp.run(spark, SF)._jdf.queryExecution().executedPlan())
    assert seen["sketches"] == seen["found-windows"] == seen["tokens"] == 1
    assert {k: v for k, v in seen.items() if v > 1} == {}


def test_release_removes_only_what_it_is_given(spark):
    from fathomline.llm._work import cut, made, release

    a, b = cut(spark.range(3), "one"), cut(spark.range(4), "two", rows=4)
    paths = made()[-2:]
    assert b.rdd.getNumPartitions() == 1
    release(spark, paths[:1])
    assert b.count() == 4 and made()[-1] == paths[1] and paths[0] not in made()
    with pytest.raises(Exception):  # noqa: B017
        a.count()
