"""Line dedup, byte-level BPE, toxicity, quality, licenses, HTML: odd inputs and brute-force versions."""

import base64
import collections
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import byte_bpe, html_text, licenses, line_dedup, quality, toxicity

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOC = "doc_id long, text string"


# ---- line dedup ---------------------------------------------------------------------------------------------------


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in hot or hot[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_odd_rows(spark):
    long, accented = "A common line that has more than forty characters in it", "Une ligne répétée ÉÀ qui compte plus de quarante signes"
    docs = [(k, f"own {k}\n  {long.upper() if k % 2 else long}\t\n{accented}\nshort") for k in range(6)] + [(7, None), (8, ""), (9, "\n\n"), (3, long), (None, long), (10, long[:39]), (11, f"{long}\n{long}"), (12, accented.replace("É", "é"))]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], f"{DOC}, n_lines string, doc_id_2 long")
    done = line_dedup.line_dedup(df)
    assert done.columns == ["doc_id", "text", "doc_id_2", "n_lines", "n_dropped"]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done.collect()), key=key) == sorted(brute_lines(docs), key=key)
    assert line_dedup.line_dedup(spark.createDataFrame([], DOC)).count() == 0


def test_line_dedup_is_linear_in_shared_lines(spark):
    """Documents of very many lines, all of them shared."""
    lines = [f"a line of more than forty characters that bears the number {k}" for k in range(60_000)]
    docs = [(k, "\n".join(lines)) for k in range(5)] + [(9, "\n".join(lines[:10] * 300))]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(docs, DOC)).collect()}
    assert [(rows[k].n_lines, rows[k].n_dropped) for k in range(4)] == [(60_000, 60_000)] * 4
    assert rows[4].n_dropped == 10 and rows[4].text == "\n".join(lines[10:]) and rows[9].n_dropped == 0 and rows[9].text == docs[5][1]


# ---- byte-level BPE -----------------------------------------------------------------------------------------------

TEXTS = ["", None, "hello world", "a" * 200_000, "  \n\t x  y", "don't WON'T", "é😀中日本語", "\x00\x01", "aaaaa aaaa aaa", "----====----", "<|endoftext|>", "   z", "1234567 89"]


def test_bpe_as_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    bits = ["a", "aa", " ", "  ", "\n", "-", "é", "1", "ab", "'s", "\t", "😀", "中", "...", "Th", "ing"]
    texts = TEXTS + ["".join(rng.choice(bits, rng.integers(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("IDS", F.lit("clash"))
    done = byte_bpe.byte_bpe(df, path, P.PATTERN, with_offsets=True)
    assert done.columns == ["doc_id", "text", "ids", "decoded", "offsets"]
    for r in done.collect():
        t = r.text or ""
        assert r.ids == want.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()
        assert len(r.offsets) == len(r.ids)
        if len(t) < 1000:
            for i, (a, b) in zip(r.ids, r.offsets, strict=True):
                assert want.decode_single_token_bytes(i) in t[a:b].encode()
    assert byte_bpe.byte_bpe(df.limit(0), path, P.PATTERN).count() == 0


def test_bpe_decodes_split_characters(spark):
    import public_tokenizers as P

    codec = byte_bpe.Codec(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    ids = codec.ids("😀")
    assert len(ids) > 1 and codec.decode(ids).decode() == "😀"
    assert codec.decode(ids[:1]) == "😀".encode()[: len(codec.decode(ids[:1]))]


# ---- toxicity -----------------------------------------------------------------------------------------------------


def test_fold():
    assert toxicity.fold("You 1D10T, Mör0n!") == toxicity.fold("you idiot  moron")
    assert toxicity.fold("іdіоt") == toxicity.fold("idiot") and toxicity.fold("") == "  "
    assert toxicity.fold("c​lown cl@wn") == toxicity.fold("clown clawn")


def test_toxicity_learns_and_spares(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("bdfgkmprtuv"), 5)) for _ in range(400)]
    insults = ["blarg", "snork", "fizzwit", "dunder"]
    rows = []
    for k in range(900):
        t = list(rng.choice(words, 60))
        if bad := k % 5 == 0:
            for w in rng.choice(insults, 3):
                t[int(rng.integers(60))] = w
        rows.append((k, " ".join(t), int(bad)))
    df = spark.createDataFrame(rows, DOC + ", toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 600"), exceptions=("snork valve",))
    assert {toxicity.fold(w) for w in insults} <= {t if t.endswith(" ") else t for t in model.weights}
    got = {r.doc_id: r for r in toxicity.toxicity(df.withColumn("Score", F.lit("clash")), model).collect()}
    wrong = sum((got[k].score >= 0.5) != bool(y) for k, _, y in rows if k >= 600)
    assert wrong <= 3
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "BL4RG sn0rk ddunder fízzwit"), (4, "the snork valve and a snork valve"), (None, "x " * 100_000)], DOC)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(odd, model).collect()}
    assert scores[1] == scores[2] == scores[4] == scores[None] < 0.5 < scores[3]
    none = toxicity.learn(df, df.where("toxic = 0"))
    assert none.weights == {} and toxicity.toxicity(df.limit(0), none).count() == 0


@here
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.toxicity(docs, toxicity.learnt(spark, sf, docs)).where(toxicity.held_out("doc_id"))
    r = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()
    share = {x.toxic: x.share for x in r}
    assert share[0] < 0.03 and share[1] > 0.88


@here
def test_toxicity_by_brute_force(spark):
    """Every document's score from a plain search for each term."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learnt(spark, SF, docs.select("doc_id", "text"))
    assert model.weights
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, SF).collect()}
    places = lambda t, x: [m.start() for m in re.finditer(f"(?={re.escape(x)})", t)]
    for r in docs.collect():
        text, heaviest = toxicity.fold(r.text or ""), {}
        spared = {k for x in model.exceptions for at in places(text, x) for k in range(at, at + len(x))}
        for term, w in model.weights.items():
            for at in places(text, term):
                if at not in spared:
                    heaviest[at] = max(w, heaviest.get(at, 0))
        n, total, length = len(heaviest), sum(heaviest.values()), np.log2(2 + text.count(" ") / 64)
        x = [(n > k) / length for k in range(3)] + [np.log1p(total) / length, np.log1p(total / length)]
        score = 1 / (1 + np.exp(-(np.dot(x, model.slopes) + model.intercept)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-12) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_keeps_rare_terms_of_a_large_vocabulary(spark):
    rng = np.random.default_rng(4)
    common = ["".join(w) for w in rng.choice(list("abcdefghijkmnopqrstuvwxyz"), (6000, 9))]
    texts = [" ".join([*rng.permutation(common), *(["zgrumbleq"] if k < 4 else [])]) for k in range(6)] + [" ".join(rng.permutation(common)) for _ in range(30)] + [f"good day {k}" for k in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(len(texts))], "doc_id long, toxic int")
    assert " zgrumbieq " in toxicity.learn(docs, labels).weights


def test_trees_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    x = np.concatenate([x, np.zeros((3000, len(quality.FEATURES) - 4))], axis=1)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[2000:2050]], forest.score(x[2000:2050]))
    assert (quality.fit(np.empty((0, len(quality.FEATURES))), np.empty(0)).score(np.zeros((2, len(quality.FEATURES)))) == 0.5).all()
    one = quality.fit(x[:50], np.ones(50)).score(x[:5])
    assert (one > 0.5).all()


def test_quality_odd_rows(spark):
    forest = quality.fit(np.empty((0, len(quality.FEATURES))), np.empty(0))
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (2, "", None), (None, "w " * 100_000, "b"), (3, " \n\n ", "c")], DOC + ", score string")
    assert sorted(quality.quality(df, forest).columns) == ["doc_id", "score", "text"]
    assert [r.score for r in quality.quality(df, forest).collect()] == [0.5] * 5
    assert quality.quality(df.limit(0), forest).count() == 0
    assert len(quality.statistics("")) == len(quality.statistics("Ab 1! é")) == len(quality.FEATURES)


@here
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op6_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) / len(scored) > 0.93


@here
def test_quality_by_brute_force(spark):
    """Every document's score by walking each tree by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out("doc_id")))
    got = {r.doc_id: r for r in quality.op6_quality(spark, SF).collect()}
    for r in docs.collect():
        x, total = quality.statistics(r.text or ""), forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        score = 1 / (1 + np.exp(-total))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2)


# ---- licenses -----------------------------------------------------------------------------------------------------


def brute_licenses(docs):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    out = {}
    for i, t in docs:
        own = runs(words(t))
        for name, template in licenses.TEMPLATES:
            s = runs(words(template))
            if (share := len(s & own) / len(s)) >= 0.8:
                out[i, name] = max(share, out.get((i, name), 0))
    return out


def test_licenses(spark):
    mit = licenses.TEMPLATES[10][1]
    filler = "some words that go before the notice and are no part of it " * 20
    docs = [(1, None), (2, ""), (3, "licensed under"), (4, filler + mit + filler), (5, mit.replace("publish", "print")), (6, "x\nLicensed under the  APACHE license, version 2.0!\ny"), (7, mit[: len(mit) // 2]), (8, "Released under the MIT License."), (8, "Licensed under CC BY-NC 4.0."), (9, "\n".join(t for _, t in licenses.TEMPLATES))]
    got = {(r.doc_id, r.license): r.containment for r in licenses.license_scan(spark.createDataFrame([(i, t, "z") for i, t in docs] + [(None, mit, "z")], DOC + ", license string")).collect()}
    assert got == pytest.approx(brute_licenses(docs))
    assert licenses.license_scan(spark.createDataFrame([], DOC)).count() == 0
    assert all(licenses.Plan().miss(t) < 1e-4 for t in range(1, 300))
    with pytest.raises(ValueError):
        licenses.license_scan(spark.createDataFrame([], DOC), (("x", "too short"),))


def test_full_licenses_and_very_long_texts(spark):
    full = {n: t for n, t in licenses.TEMPLATES if len(t.split()) > 150}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause"} <= set(full)
    filler = " ".join(f"w{k}" for k in range(60_000))
    docs = [(k, f"{filler}\n{t.upper()}\n{filler}") for k, t in enumerate(full.values())] + [(99, filler * 3)]
    got = {(r.doc_id, r.license): r.containment for r in licenses.license_scan(spark.createDataFrame(docs, DOC)).collect()}
    assert got == pytest.approx(brute_licenses(docs)) and {(k, n) for k, n in enumerate(full)} <= set(got)


@here
def test_licenses_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()}
    assert got == set(brute_licenses([(r.doc_id, r.text) for r in docs.collect()]))


# ---- HTML ---------------------------------------------------------------------------------------------------------


def test_tree_fits_its_table():
    assert all(html_text.is_main(list(map(float, f))) == bool(y) for f, y in html_text.LABELLED)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("just words, " * 10, "just words, " * 9 + "just words,"),
        ("<article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree&nbsp;&#33;</p><aside>x</aside></article><footer>f</footer>", "A & B\none two three !"),
        ('<nav><a href=/>m</a></nav><main><p>Text in main.</p><div class="cookie-notice">We set cookies</div><form>Name <button>go</button></form></main>', "Text in main."),
        ('<article><p>Body</p><div id="comments"><article><p>A reader says so</p></article></div></article>', "Body"),
        ("<article><p>cut &lt;here", "cut <here"), ('<article><p>a <a title="x>y" href=#>link</a> b<script>if (a<b) "</p>"</script></p></article>', "a link b"), ("<article><style>p{}</style><!-- <p>no</p> --><p>yes</article>", "yes"),
        ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"), ("<header><h1>Site</h1></header><article><header>by x</header><p>t</p></article>", "t"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("wrapper", ["article class='post comments-open'", "div class='content with-sidebar'", "div class='main no-header'", "div class='hfeed hasWidgets'", "article class='post search-result'"])
def test_names_that_tell_what_stands_beside(wrapper):
    body = "<p>" + "a long text of many words " * 10 + "</p>"
    assert html_text.main_text(f"<{wrapper}>{body}</{wrapper.split()[0]}><div class='post-comments'><p>a reader</p></div>") == ("a long text of many words " * 10).strip()


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='content no-sidebar'", "div class='site-content with-header'", "article class='post has-header'", "div class='entry share-enabled'", "div class='sidebar-layout'", "div id='notice-board'", "div class='comments search'"])
@pytest.mark.parametrize("inner", ["article", "div class=text"])
def test_a_wrapper_is_no_boilerplate_whatever_its_name(wrapper, inner):
    paragraphs = [" ".join(f"word{k}{j}" for j in range(25 + 7 * k)) for k in range(4)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><ul class=menu><li><a href=/>One</a></li><li><a href=/b>Two</a></li></ul>"
    beside = "<div class='cookie-notice'>We set cookies, read on</div><aside>see also <a href=/>this</a></aside><div id=comments><p>A reader says so here</p><p>another says no</p></div>"
    inside = "<div class='newsletter'>Sign up for our letter now</div>"
    page = f"<html><body>{menu}<{wrapper}><{inner}><h1>A title</h1>{body}</{inner.split()[0]}>{inside}</{wrapper.split()[0]}>{beside}<footer>f</footer></body></html>"
    text = html_text.main_text(page).split("\n")
    assert text[:5] == ["A title", *paragraphs] and not {"Home", "One", "We set cookies, read on", "A reader says so here", "f"} & set(text)


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<article><p>" + "word " * 100_000, None)], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(df).collect()
    assert html_text.extract_text(df).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in rows) == [0, 0, 499_999]
    assert html_text.extract_text(df.limit(0)).count() == 0


@here
def test_pages_against_a_plain_cut(spark):
    import html as h

    def plain(page):
        m = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
        return "\n".join(t for t in (" ".join(h.unescape(re.sub(r"<[^>]+>", " " if "<br" in p else "", p)).split()) for p in parts) if t)

    for r in html_text.op8_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == plain(r.html)
    assert hashlib.sha1(b"").hexdigest()
