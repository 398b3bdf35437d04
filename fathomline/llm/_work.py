"""Shared plumbing: the shared working folder, lineage cuts, column-name hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column; inputs never lose a column of their own to it.
P = "_fl_"
_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with the scheme of the store that Spark finds it in.

    Only a local master, as in tests, may leave it unset: then a folder of this machine is made and kept for the session.
    Elsewhere other machines would not see such a folder: ValueError."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _LOCAL[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='fathomline-')}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at.rstrip("/"))
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() removes it."""
    _MADE.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def made() -> list[str]:
    """The paths that fresh_path() gave and release() has not removed, in order."""
    return list(_MADE)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove these of made(): for callers who have written what they need elsewhere, as results read them when they run."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        _MADE.remove(p)


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it is computed once, and survives lost executors.

    rows: about how many there are, where that is known: the table gets a file for each 200,000, however many partitions
    the session shuffles to."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.repartition(max(1, -(-rows // 200_000)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than 1/HOT of all rows is broadcast; fewer than HOT keys can be such.
HOT = 4096


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with counts (a row per key; n: how many of rows bear the key; total: of all rows).

    Rows of the keys that hold more than total/HOT each stay where they are and meet a broadcast of fewer than HOT rows;
    the others are joined by shuffles in which no key has more than total/HOT rows."""
    hot = F.broadcast(counts.where(F.col(n) * HOT > total))
    near = rows.join(hot, keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counts.where(F.col(n) * HOT <= total), keys)
    return near.unionByName(far)


def sifting(rows: DataFrame, wanted: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """rows with a boolean column flag: false where the keys are surely not among wanted's (or null).

    A bit map of the wanted keys' hashes is broadcast, at most 2**20 rows of 64 bits however many they are."""
    known_key = F.lit(True)
    for k in keys:
        known_key = known_key & F.col(k).isNotNull()
    place = lambda df: df.withColumn(P + "h", F.when(known_key, F.xxhash64(*keys))).withColumn(P + "word", F.shiftrightunsigned(P + "h", 44))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({P}h, 38) & 63 as int))")
    known = place(wanted.select(*keys)).where(F.col(P + "h").isNotNull()).groupBy(P + "word").agg(F.bit_or(bit).alias(P + "bits"))
    marked = place(rows).join(F.broadcast(known), P + "word", "left")
    return marked.select(*rows.columns, F.coalesce(F.col(P + "bits").bitwiseAND(bit) != 0, F.lit(False)).alias(flag))


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys are not among wanted's: what a join with wanted then shuffles is what it
    needs and few rows more, or, with far more keys than sifting()'s bits, all rows."""
    return sifting(rows, wanted, keys, P + "known").where(P + "known").select(*rows.columns)


def sole(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """df's needed columns under helper names: {helper: column}. A missing column is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).alias(h) for h, c in needed.items()])


def others(df: DataFrame, taken: list[str]) -> list[str]:
    """df's columns but those whose names (without regard to case) an operator's output takes."""
    low = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in low]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
