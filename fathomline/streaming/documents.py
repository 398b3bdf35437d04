"""Documents as a stream: the batch operators are row-local, so they run unchanged; no state, no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.corpus import validate_corpus
from fathomline.sources.documents import decode_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """path, length, modified, content of files as they come; a trigger takes a bounded number of them."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def stream_results(files: DataFrame, contracts: list, schemas: dict, **options) -> DataFrame:
    """validate_corpus over a stream of files, append mode."""
    return validate_corpus(decode_files(files, options.get("profile", "frontmatter-md")), contracts, schemas, **options)


def write_results(results: DataFrame, table_path: str, checkpoint: str, available_now: bool = True):
    """Append results as Parquet; each file's results are written exactly once."""
    writer = results.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
