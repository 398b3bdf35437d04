"""Quality: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import others, sole, table

FEATURES = (
    "chars", "words", "word_length", "longest_word", "different_words", "different_pairs", "lines",
    "different_lines", "words_a_line", "upper", "lower", "digits", "spaces", "beyond_ascii", "signs",
    "commonest_sign", "ends_of_sentences", "entropy", "short_words", "signs_a_word",
)

_BYTE = np.arange(256)
_KINDS = np.stack([(_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57), np.isin(_BYTE, [9, 10, 11, 12, 13, 32]), _BYTE >= 128]).astype(np.float64)
_SIGN = ((_BYTE > 32) & (_BYTE < 127) & ~_KINDS[:3].any(axis=0)).astype(np.float64)


def statistics(text: str) -> list[float]:
    """One number for each of FEATURES, over the whole text; a text without words has zeros where it would divide."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256).astype(np.float64)
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    kinds = _KINDS @ counts / n
    signs = counts * _SIGN
    share = counts[counts > 0] / n
    lengths = [len(x) for x in words]
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(lengths) / w, float(max(lengths, default=0)), len(set(words)) / w, len(set(zip(words, words[1:], strict=False))) / w,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), len(words) / len(lines), *kinds.tolist(), float(signs.sum()) / n, float(signs.max()) / n,
        (counts[46] + counts[33] + counts[63]) / w, float(-(share * np.log2(share)).sum()), sum(x < 3 for x in lengths) / w, float(signs.sum()) / w,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees one after another: node i asks whether feature[i] <= threshold[i]; leaves lead to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
    least: float = 2.0, penalty: float = 1.0,
) -> Forest:
    """Boosted trees for the logistic loss: splits between quantile bins by gain, each child with `least` summed curvature.

    No rows: every score is 0.5. One class only: no tree splits, and scores tend to that class."""
    n, f = x.shape if len(y) else (0, len(FEATURES))
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(f)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.empty((0, f), int)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    margin = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(feature))
        queue = [(np.arange(n), 0, _leaf(feature, threshold, left, right, value))]
        while queue:
            rows, level, node = queue.pop()
            g, h = grad[rows].sum(), curve[rows].sum()
            value[node] = float(-rate * g / (h + penalty))
            best = (1e-6, -1, -1)
            if level < depth and h >= 2 * least:
                for j in range(f):
                    if not len(cuts[j]):
                        continue
                    gl = np.cumsum(np.bincount(coded[rows, j], grad[rows], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(coded[rows, j], curve[rows], len(cuts[j]) + 1))[:-1]
                    gain = np.where(
                        (hl >= least) & (h - hl >= least),
                        gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty), -1,
                    )
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), j, k))
            if best[1] < 0:
                margin[rows] += value[node]
                continue
            _, j, k = best
            goes = coded[rows, j] <= k
            a, b = (_leaf(feature, threshold, left, right, value) for _ in range(2))
            feature[node], threshold[node], left[node], right[node], value[node] = j, float(cuts[j][k]), a, b, 0.0
            queue += [(rows[goes], level + 1, a), (rows[~goes], level + 1, b)]
    return Forest(
        np.array(roots, int), np.array(feature, int), np.array(threshold, float), np.array(left, int),
        np.array(right, int), np.array(value, float), base, depth,
    )


def _leaf(feature: list, threshold: list, left: list, right: list, value: list) -> int:
    node = len(feature)
    for into, v in ((feature, 0), (threshold, 0.0), (left, node), (right, node), (value, 0.0)):
        into.append(v)
    return node


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py() or "") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def document_statistics(text: Column | str) -> Column:
    """array<double> of FEATURES."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_matrix(batch).tolist(), pa.list_(pa.float64()))

    return run(text)


def learn(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 20_000,
) -> Forest:
    """Trees fitted on the labelled rows given: on a sample of at most `sample` ids, those with the least hash of the id.

    An id with several labels counts by the smallest; null ids, null labels and labels without a document don't count."""
    lab = sole(labelled, {"i": id_col, "y": label_col}).where("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"))
    chosen = lab.orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = sole(docs, {"i": id_col, "t": text_col}).join(F.broadcast(chosen), "i").select(
        "i", document_statistics(F.coalesce("t", F.lit(""))).alias("x"), (F.col("y") > 0).cast("double").alias("y"),
    ).toPandas().sort_values("i")
    return fit(np.stack(rows["x"].to_list()) if len(rows) else np.empty((0, len(FEATURES))), rows["y"].to_numpy())


def quality(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: better); a column of that name is replaced. Null texts score as empty ones.

    Rows are scored one by one on their whole text: repeated rows, nulls elsewhere and empty tables need no rule."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score(_matrix(batch)), pa.float64())

    return docs.select(*[F.col(f"`{c}`") for c in others(docs, ["score"])], run(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("score"))


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 4 == 2


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents, repeated ids too; held_out is null where the id is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return quality(docs, forest).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
