"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

DataFrame functions only. A row per (hash, document) is written once, with the positions of the line there. Counting is
combined before its shuffle. To find the lines to drop, these rows meet the table of shared lines: lines that many
documents hold by a broadcast of a bounded number of them, the others by their hash. A document's text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import P, cut, join_counted, others, sole, table

#: What counts as white space at a line's ends, and the letters that are lower-cased.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line).cast("binary")))


def _long_enough(line: Column, min_chars: int) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines that min_docs or more documents hold, but for the document with the largest id.

    Returns docs' columns, text without the dropped lines, and n_lines (before), n_dropped. Columns of docs named
    n_lines or n_dropped are replaced. Nulls and empty texts: one empty line, text "". A document is a distinct id:
    rows that repeat an id count once and are treated alike; rows without an id are never counted and lose nothing.
    An empty table gives an empty one. Keys are compared by their 128-bit MD5, texts of a repeated id by 64 bits. Time
    and memory are in proportion to a document's lines, however many of them are dropped.
    """
    d, t, h, v = P + "id", P + "text", P + "hash", P + "version"
    line, at, keep = F.col(P + "line"), F.col(P + "at"), P + "keep"
    pairs = cut(
        sole(docs, {d: id_col, t: text_col})
        .where(F.col(d).isNotNull() & (F.length(t) >= min_chars))
        .select(d, F.xxhash64(t).alias(v), F.split(t, "\n", -1).alias(t))
        .select(d, v, F.posexplode(t).alias(P + "at", P + "line"))
        .where(_long_enough(line, min_chars))
        .select(d, _hash(line).alias(h), F.struct(v, at.alias("at")).alias(P + "spot"))
        .groupBy(h, d)
        .agg(F.collect_set(P + "spot").alias(P + "spots")),
        "line-documents",
    )
    most = pairs.count()
    shared = pairs.groupBy(h).agg(F.count(F.lit(1)).alias(P + "docs"), F.max(d).alias(keep)).where(F.col(P + "docs") >= min_docs)
    shared = cut(shared, "shared-lines")
    spots = join_counted(pairs, shared, [h], P + "docs", most).where(F.col(d) != F.col(keep)).select(d, F.inline(P + "spots"))
    dropped = spots.groupBy(d, v).agg(F.array_sort(F.collect_set("at")).alias(P + "gone"))
    rest = others(docs, ["n_lines", "n_dropped", id_col, text_col])
    have = {c.lower(): c for c in docs.columns}
    ids, text = F.col(f"`{have[id_col.lower()]}`"), F.coalesce(F.col(f"`{have[text_col.lower()]}`"), F.lit(""))
    named = docs.select(ids.alias(d), F.xxhash64(text).alias(v), F.split(text, "\n", -1).alias(P + "lines"), *[F.col(f"`{c}`") for c in rest])
    joined = named.join(dropped, [d, v], "left")
    n, gone = F.size(P + "lines"), F.col(P + "gone")
    # from each dropped position to the next: the lines between them are put together again, each copied once
    spans = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(n)).alias("b"))
    between = F.transform(spans, lambda x: F.slice(P + "lines", x["a"] + 2, x["b"] - x["a"] - 1))
    left = F.when(gone.isNull(), F.col(P + "lines")).otherwise(F.flatten(between))
    kept = joined.withColumn(P + "kept", F.array_join(left, "\n"))
    out = {id_col: F.col(d), text_col: F.col(P + "kept"), **{c: F.col(f"`{c}`") for c in rest}}
    order = [c for c in docs.columns if c in out] + [c for c in out if c not in docs.columns]
    return kept.select(
        *[out[c].alias(c) for c in order], n.cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, s.keep IS NOT NULL AND k.doc_id <> s.keep AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
