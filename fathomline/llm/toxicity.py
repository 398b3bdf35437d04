"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding strips marks, maps look-alike letters and digit substitutions to one letter each, and turns everything that is
no letter or digit into single spaces; a term is " word " or, for a stem with several endings, " stem". Terms, weights
and the two numbers that turn a density into a probability are learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import P, cut, others, sole, table

# Look-alike letters of other scripts, digits and signs that stand for letters. l, 1 and i fold alike.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ℓ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i"}
SIGNS = {"@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a word of a lexicon means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "white trash bag", "circus clown", "clown fish", "class clown", "pond scum", "soap scum")

_TABLE = str.maketrans(LOOKALIKES | DIGITS | dict.fromkeys(INVISIBLE, ""))
_SIGN = re.compile(r"(?<=\w)[@$](?=\w)")
_GAP = re.compile(r"[\W_]+")
_MARK = re.compile(r"[̀-ͯ]+")


def fold(text: str) -> str:
    """The text in the lexicon's alphabet, with a space at both ends."""
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    text = text.translate(_TABLE)
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {_GAP.sub(' ', text).strip()} "


#: Features of a text without hits.
NONE = (0.0, 0.0, 0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Model:
    """weights: of folded terms; exceptions: folded phrases; slopes and intercept: of the log-odds in Matcher.features."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slopes: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0)
    intercept: float = -1.0


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, w in weights.items():
            self.machine.add_word(term, (len(term), w))
        for phrase in exceptions:
            self.machine.add_word(phrase, (len(phrase), None))
        self.any = bool(weights)
        if self.any:
            self.machine.make_automaton()

    def features(self, text: str) -> tuple[float, ...]:
        """Whether one, two and three words are hit, and logarithms of one plus the summed weights: all over a slowly growing length, the last inside the logarithm too.

        A word counts once, by its heaviest term; words inside an exception phrase don't count."""
        if not self.any:
            return NONE
        folded = fold(text)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.machine.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            else:
                hits[start] = max(w, hits.get(start, 0.0))
        kept = _outside(hits, spared) if spared else hits
        if not kept:
            return NONE
        total = sum(kept.values())
        n = len(kept)
        length = math.log2(2 + folded.count(" ") / 64)
        return 1.0 / length, (n > 1) / length, (n > 2) / length, math.log1p(total) / length, math.log1p(total / length)


def _outside(hits: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The hits at places in none of the spans, by one pass over both in order."""
    spans = sorted(spans)
    kept, k, end = {}, 0, -1
    for at in sorted(hits):
        while k < len(spans) and spans[k][0] <= at:
            end, k = max(end, spans[k][1]), k + 1
        if at >= end:
            kept[at] = hits[at]
    return kept


def _features(text: Column | str, shared) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(*shared.value)
        for batch in batches:
            yield pa.array([matcher.features(t.as_py() or "") for t in batch], pa.list_(pa.float64()))

    return run(text)


def _terms(words: set[str]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(4, min(len(w), 8))}


def _origin(words: list[str]) -> int:
    """The same for most near copies, so that a much copied text counts about once."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def _held(words: set[str]) -> set[str]:
    """The terms, of whatever text, that the matcher finds in a text of these words."""
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(4, min(len(w), 7) + 1)}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term: origin of each toxic text that it is of; numbers of toxic and of clean texts that hold it."""
    for batch in batches:
        rows: list[tuple[str, int | None, int, int]] = []
        clean: Counter = Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = fold(text or "").split()
            held = _held(set(words))
            if not y:
                clean.update(held)
                continue
            origin, own = _origin(words), _terms(set(words))
            rows += [(t, origin if t in own else None, 1, 0) for t in held]
        rows += [(t, None, 0, n) for t, n in clean.items()]
        yield pa.record_batch(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["term", "origin", "tox", "non"],
        )


def learn(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 20_000, min_origins: int = 4, min_log_odds: float = 2.0, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """A Model from the labelled rows given.

    It is fitted on a sample of at most `sample` labelled ids (those with the least hash of the id). Terms are
    counted on the executors; those of min_origins toxic texts or more that reach min_log_odds come to the driver. An id with several labels counts by the largest; null
    ids, null labels and labels without a document count for nothing. With no toxic or no clean row nothing is learnt,
    and every score is that of a text without hits.
    """
    spark = docs.sparkSession
    spared = tuple(dict.fromkeys(fold(x) for x in exceptions))
    lab = sole(labelled, {"i": id_col, "y": label_col}).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    chosen = lab.orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = cut(
        sole(docs, {"i": id_col, "t": text_col}).join(F.broadcast(chosen), "i").select("t", (F.col("y") > 0).cast("int").alias("y")),
        "toxicity-sample",
    )
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tox, n_non = n.get(1, 0), n.get(0, 0)
    if not n_tox or not n_non:
        return Model(exceptions=spared)
    found = rows.select("t", "y").mapInArrow(_counts, "term string, origin long, tox long, non long").groupBy("term").agg(
        F.countDistinct("origin").alias("n"), F.sum("tox").alias("tox"), F.sum("non").alias("non"),
    )
    tox, non = F.col("tox") + 0.5, F.col("non") + 0.5
    reached = F.log(tox / (n_tox + 1)) - F.log(non / (n_non + 1)) - F.sqrt(1 / tox + 1 / non) >= min_log_odds - 1e-9
    kept = found.where((F.col("n") >= min_origins) & reached).orderBy(F.desc("n"), "term").collect()
    odds = {r["term"]: _log_odds(r["tox"], n_tox, r["non"], n_non) for r in kept}
    weights = _choose({t: o for t, o in odds.items() if o >= min_log_odds})
    fitted = rows.select(_features("t", spark.sparkContext.broadcast((weights, spared))).alias("x"), "y").toPandas()
    slopes, intercept = logistic(np.stack(fitted["x"].to_list()), fitted["y"].to_numpy())
    return Model(weights, spared, slopes, intercept)


def _log_odds(tox: int, n_tox: int, non: int, n_non: int) -> float:
    """Of a text with the term to be toxic, one standard error below the estimate: rare terms weigh less."""
    return math.log((tox + 0.5) / (n_tox + 1)) - math.log((non + 0.5) / (n_non + 1)) - math.sqrt(1 / (tox + 0.5) + 1 / (non + 0.5))


def _choose(odds: dict[str, float]) -> dict[str, float]:
    """Whole words, and the shortest stems that are no part of just one of them."""
    words = [t for t in odds if t.endswith(" ")]
    endings = Counter(t[: k + 1] for t in words for k in range(4, len(t) - 2))
    stems: list[str] = []
    for t in sorted((t for t in odds if not t.endswith(" ")), key=len):
        if endings[t] >= 3 and not any(t.startswith(s) for s in stems):
            stems.append(t)
    return {t: odds[t] for t in [*words, *stems]}


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, penalty: float = 1e-3) -> tuple[tuple[float, ...], float]:
    """Slopes and intercept by Newton's method with a small penalty; both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * len(y) * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * len(y) * np.eye(x.shape[1])
        beta = beta - np.linalg.solve(hess, grad)
    return tuple(float(v) for v in beta[:-1]), float(beta[-1])


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1); a column of that name is replaced. Null and empty texts score as texts without hits.

    Rows are scored one by one on their whole text: repeated rows, nulls elsewhere and empty tables need no rule."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.exceptions))
    x = _features(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), shared)
    rest = [F.col(f"`{c}`") for c in others(docs, ["score"])]
    odds = sum((F.lit(b) * F.col(P + "x")[k] for k, b in enumerate(model.slopes)), F.lit(model.intercept))
    return docs.select(*rest, x.alias(P + "x")).select(*rest, (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("score"))


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 5 == 0


def learnt(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model of op10 and of the pipeline: labels of held-out ids are not read into it."""
    return learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents, repeated ids too; held_out is null where the id is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, learnt(spark, sf_dir, docs))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
