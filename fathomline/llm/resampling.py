"""Target-distribution importance resampling: documents drawn as a target's runs of words weigh them.

Within a slice of texts each distinct word gets an integer from a dictionary, each run of words is a tuple of such
integers, and the bytes that a distinct tuple stands for are hashed once: those of its last word, from where the hash of
the tuple without it left off. The counts of the occurrences are joined back by the tuples' numbers. A slice is bounded,
so is its dictionary; of a corpus only the counts of the buckets, a bounded number, leave the tasks.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._order import AT, ordered, running
from ._work import P, cut, sole, table

#: Bytes of words as they count (A-Z in lower case), all others a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text whose words share a dictionary; longer texts are read in pieces.
SLICE = 1 << 20


def _pieces(texts: Iterator[tuple[int, bytes]], longest: int, size: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(row, words, how many of them were in the piece before) of each piece of each text."""
    for row, text in texts:
        low = text.translate(FOLDED)
        at, held = 0, []
        while at < len(low):
            end = low.find(b" ", at + size) if at + size < len(low) else -1
            end = end if end >= 0 else len(low)
            words = held + low[at:end].split()
            yield row, words, len(held)
            held, at = words[max(0, len(words) - longest + 1) :], end


def _slices(texts: Iterator[tuple[int, bytes]], longest: int, size: int) -> Iterator[list[tuple[int, list[bytes], int]]]:
    held, total = [], 0
    for row, words, old in _pieces(texts, longest, size):
        held.append((row, words, old))
        total += sum(map(len, words)) + len(words)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def runs(pieces: list[tuple[int, list[bytes], int]], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... `longest` words: the row and the bucket of each that ends in a word that is new in its piece."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = [len(words) for _, words, _ in pieces]
    word = np.fromiter((number[w] for _, words, _ in pieces for w in words), np.int64, sum(sizes))
    piece = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum([0, *sizes[:-1]]) if sizes else np.empty(0, np.int64), sizes)
    row = np.array([r for r, _, _ in pieces], np.int64)[piece]
    fresh = place >= np.array([old for _, _, old in pieces], np.int64)[piece]
    spelled = list(number)
    hashed = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    more = [b" " + w for w in spelled]
    run = word  # of each word, the number of the distinct tuple that ends there
    yield row[fresh], hashed[run[fresh]] % buckets
    for k in range(1, longest):
        ends = np.flatnonzero(place >= k)
        code, distinct = pd.factorize(run[ends - 1] * len(spelled) + word[ends])
        first, last = np.divmod(distinct, max(1, len(spelled)))
        hashed = np.fromiter(map(zlib.crc32, map(more.__getitem__, last.tolist()), hashed[first].tolist()), np.int64, len(distinct))
        run = np.zeros(len(word), np.int64)
        run[ends] = code
        ends = ends[fresh[ends]]
        yield row[ends], hashed[run[ends]] % buckets


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    return ((k, t.as_py() or b"") for k, t in enumerate(column))


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many runs of 1 to `longest` words of all texts hash to it; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for pieces in _slices(_texts(batch.column(0)), longest, SLICE):
                for _, bucket in runs(pieces, longest, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(n[at])})

    texts = sole(docs, {"t": text_col}).select(F.col("t").cast("binary").alias("t"))
    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = 3, buckets: int = 10_000) -> np.ndarray:
    """Of each bucket: floor(1000 ln) of how much likelier it is in the target, by counts with one added to every bucket."""
    ours, theirs = bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets)
    both = (
        docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
        .join(ours.select("bucket", F.col("n").alias("s")), "bucket", "left").join(theirs.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    )
    rows = both.toPandas()  # a row for each bucket
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[rows["bucket"]], t[rows["bucket"]] = rows["s"], rows["t"]
    up, down = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(up.tolist(), down.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 3) -> DataFrame:
    """id, n_words, n_features, weight of each row of docs."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, features, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for pieces in _slices(_texts(batch.column(1)), longest, SLICE):
                for k, (row, bucket) in enumerate(runs(pieces, longest, buckets)):
                    n = np.bincount(row, minlength=size)
                    words += n if k == 0 else 0
                    features += n
                    weight += np.bincount(row, shared.value[bucket], minlength=size).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = sole(docs, {"id": id_col, "t": text_col}).select("id", F.col("t").cast("binary").alias("t"))
    if rows.schema["id"].dataType.simpleString() == "void":  # docs have no ids
        rows = rows.withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(weigh, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate drawn from the id's hash: with it, the highest scores are a draw by weight without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42,
) -> DataFrame:
    """A row per row of docs: id (under its name), n_words, n_features, weight, score, rank.

    Words are runs of ASCII letters and digits and of all beyond ASCII, A-Z in lower case; features are runs of 1 to `longest` words. weight is the sum of
    gains() over a document's features; score adds noise(). Of the rows with min_words or more, `percent` in a hundred
    (rounded down) are drawn, highest scores first, then smaller ids, null ids last; rank is null for the others.
    drawn() gives their texts. Null and empty texts have no features and weight 0. Rows that repeat an id are scored
    each by its own text and take ranks of their own; a null id draws its noise from an empty one. Columns that docs has
    besides are not read. No documents or no target: every gain is that of empty counts; an empty table gives an empty one."""
    gain = gains(docs, target, text_col, target_col, longest, buckets)
    # written before it is ordered: to find the ranges of an order takes a pass of its own
    weights = cut(weighed(docs, gain, id_col, text_col, longest), "weights")
    scored = weights.select("*", (F.col("n_words") >= min_words).alias("fit"), (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    placed = ordered(scored, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id")], scored.columns, "resampling")
    of = placed.where("fit").count() * percent // 100
    place = running(placed.withColumn(P + "one", F.lit(1).cast("long")), [], {P + "rank": ("sum", P + "one")})
    rank = F.when(F.col("fit") & (F.col(P + "rank") <= of), F.col(P + "rank"))
    return place.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Those of docs whose id importance_resample() drew, as they are: rows of a drawn id all come, null ids never."""
    return docs.join(resampled.where("rank is not null").select(id_col).distinct(), id_col, "left_semi")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


_RUNS = """
  SELECT {id} AS id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})
"""
#: crc32 by its table of 256 remainders, byte for byte.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rest"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || hex(encode({s}))[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295)"

OP11_SQL = f"""
WITH rests AS ({CRC_TABLE}),
d AS (SELECT id, f, count(*) AS n FROM ({_RUNS.format(id="doc_id", table="documents")}) GROUP BY id, f),
b AS (SELECT f, count(*) AS n FROM ({_RUNS.format(id="item_id", table="benchmark")}) GROUP BY f),
h AS (SELECT f, {CRC.format(s="f")} % 10000 AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b), rests),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM d JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM b JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
        / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT id, sum(d.n)::BIGINT AS n_features, sum(d.n * gain)::BIGINT AS weight FROM d JOIN h USING (f) JOIN g USING (bucket) GROUP BY id),
x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score,
        coalesce(n_features, 0) >= 57 AS fit
      FROM documents LEFT JOIN w ON id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () AS fits FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * fits // 100 THEN place::BIGINT END AS rank FROM r
"""
