"""A corpus from raw documents to checked token ids: toxicity, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns ids.
Columns of documents that are missing are null from the first stage on; further columns are not carried on. Documents
without an id pass the stages that work by id. Every text that a stage changes has its n_chars set anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import byte_bpe as bpe
from fathomline.llm import toxicity as tox
from fathomline.llm._work import cut, made, release, sole, table
from fathomline.llm.decontaminate import decontaminate
from fathomline.llm.jaccard_join import jaccard_join
from fathomline.llm.line_dedup import line_dedup

#: The columns of documents.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def plain(docs: DataFrame) -> DataFrame:
    """docs with the columns of documents and no other."""
    return sole(docs, {c: c for c in COLUMNS}).select(*[F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is 0.5 or more."""
    scored = tox.toxicity(plain(docs), tox.learnt(spark, sf_dir, plain(docs)))
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that five documents or more hold; a document left without lines stays, with an empty text."""
    return line_dedup(plain(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the least id. Rows that repeat an id and its text stay or go together."""
    rows = jaccard_join(plain(docs)).groupBy("doc_id", "version").agg(F.max("kept").alias("kept"))
    removed = rows.where(~F.col("kept")).select("doc_id", "version")
    versions = plain(docs).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    return versions.join(removed, ["doc_id", "version"], "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of a benchmark item, re-parameterised or not."""
    leaked = decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return plain(docs).join(leaked, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of the ids and of what they decode to."""
    import public_tokenizers

    done = bpe.byte_bpe(plain(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    digests = F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return done.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), *digests)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: Learning, near duplicates and encoding have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. Each stage's own tables, and what it read, are removed once its result is written."""
    before = made()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, [p for p in made()[:-1] if p not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
