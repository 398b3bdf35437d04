"""Texts written to files in two steps: all are staged beside the folder's files, then moved into place.

Staging touches no file of the folder, so a job that fails there is undone by removing what it staged. The manifest of what
is staged is a table in the staging folder; moving by it can be begun again at any place, so a job that ends half way is finished, not
undone. A file is replaced at once or not at all, and only while it still holds the text that was read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import opened

MANIFEST = "path string, staged string, old_sha256 string, new_sha256 string"
STAGING = ".fathomline-staging-"
#: What becomes of a file. conflict: it holds another text than the one read, or is there where none was.
STATUSES = ("replaced", "unchanged", "conflict")


def _sha(fs, path: str) -> str | None:
    """Of a file's bytes; None where there is no file."""
    if fs.get_file_info(path).type.name != "File":
        return None
    digest = hashlib.sha256()
    with fs.open_input_stream(path) as file:
        while chunk := file.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def stage(rows: DataFrame, root: str) -> str:
    """Stages rows (path, below root; text; old: the text that was read, null for a new file) and gives the staging folder's URI.

    Rows whose text is null, or the old one, are left out. Two rows with a path: ValueError when they are moved. If staging
    fails nothing is left of it."""
    at = f"{root.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder, _ = opened(at)
        for batch in batches:
            done = []
            for path, text, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, target, _ = opened(path)
                if not target.startswith(folder.rpartition("/")[0] + "/"):
                    raise ValueError(f"{path} is not below {root}")
                data = text.encode("utf-8")
                staged = f"{folder}/{uuid.uuid4().hex}"  # an attempt's own; those of lost ones go with the folder
                with fs.open_output_stream(staged) as file:
                    file.write(data)
                done.append((path, staged, None if old is None else hashlib.sha256(old.encode("utf-8")).hexdigest(), hashlib.sha256(data).hexdigest()))
            yield pa.record_batch([pa.array([d[k] for d in done], pa.string()) for k in range(4)], ["path", "staged", "old_sha256", "new_sha256"])

    fs, folder, _ = opened(at)
    fs.create_dir(folder, recursive=True)
    try:
        wanted = rows.select("path", "text", "old").where("text is not null and not (text <=> old)")
        wanted.mapInArrow(run, MANIFEST).write.parquet(f"{at}/manifest")
    except BaseException:
        undo(at)
        raise
    return at


def undo(staging: str) -> None:
    """Removes what was staged and not moved."""
    fs, folder, _ = opened(staging)
    fs.delete_dir(folder)


def commit(spark: SparkSession, staging: str) -> DataFrame:
    """Moves what was staged into place: path, status (of STATUSES) per file. The result is a table in the staging folder, which finish() removes.

    Moves that an earlier attempt, or call, has made count as replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, _ = opened(staging)
        for batch in batches:
            paths, found = [], []
            for path, staged, old, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, target, _ = opened(path)
                now = _sha(fs, target)
                if now == new:
                    status = "replaced" if old != new else "unchanged"
                elif now != old:
                    status = "conflict"
                else:
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    try:
                        fs.move(staged, target)
                    except OSError:
                        if _sha(fs, target) is None:
                            raise
                        fs.delete_file(target)  # a store whose moves don't replace
                        fs.move(staged, target)
                    status = "replaced"
                paths.append(path)
                found.append(status)
            yield pa.record_batch({"path": pa.array(paths, pa.string()), "status": pa.array(found, pa.string())})

    manifest = spark.read.schema(MANIFEST).parquet(f"{staging}/manifest")
    if again := manifest.groupBy("path").count().where("count > 1").first():
        raise ValueError(f"two texts for {again['path']}")
    done = f"{staging}/done-{uuid.uuid4().hex}"
    manifest.mapInArrow(run, "path string, status string").write.parquet(done)
    return spark.read.schema("path string, status string").parquet(done)


finish = undo


def rewrite(rows: DataFrame, root: str) -> dict[str, int]:
    """stage(), commit() and finish(): how many files have each status. A failure to stage leaves all files as they were."""
    staging = stage(rows, root)
    counts = {r["status"]: r["n"] for r in commit(rows.sparkSession, staging).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    finish(staging)
    return counts
