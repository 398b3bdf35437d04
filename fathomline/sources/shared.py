"""A folder that driver and executors share, for what has to be written in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names; on a local master without one, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="fathomline-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
