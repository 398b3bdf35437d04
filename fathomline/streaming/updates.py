"""Results that follow their documents: when a document comes again, what was said of its earlier version is taken back.

A changelog of +1 and -1 rows can be summed in any order, so totals over it are those of a batch over the latest versions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key string, version long, value string, sign int"
STATE = "version long, value string"


def _follow(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of what has come and what is known the latest counts; of equal versions the greater value, a deletion last."""
    known = state.get if state.exists else None
    best = known
    rank = lambda x: (x[0], x[1] is not None, x[1] or "")
    for batch in batches:
        for version, value in zip(batch["version"], batch["value"], strict=True):
            new = (int(version), None if value is None or value != value else value)
            if best is None or rank(new) > rank(best):
                best = new
    if best is None or best == known:
        return
    state.update(best)
    rows = [(key[0], *known, -1)] if known is not None and known[1] is not None else []
    rows += [(key[0], *best, 1)] if best[1] is not None else []
    if rows and (known is None or known[1] != best[1]):
        yield pd.DataFrame(rows, columns=["key", "version", "value", "sign"])


def changes(results: DataFrame, key: str, version: Column, values: list[str], deleted: Column | None = None) -> DataFrame:
    """The changelog (CHANGES) of a stream of results: value is the JSON of `values`.

    version (a number or time) tells which of a key's results is the latest, in whatever order they come; one that is no later,
    or says the same, changes nothing. deleted: rows that only take back. Rows without a key or version are left out. State is one
    row a key."""
    value = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    micros = F.unix_micros(version) if dict(results.select(version.alias("v")).dtypes)["v"].startswith("timestamp") else version.cast("long")
    rows = results.select(F.col(key).cast("string").alias("key"), micros.alias("version"), (value if deleted is None else F.when(~deleted, value)).alias("value"))
    rows = rows.where("key is not null and version is not null")
    return rows.groupBy("key").applyInPandasWithState(_follow, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def current(changelog: DataFrame, schema: str) -> DataFrame:
    """A batch read of a changelog: the columns of schema, n: how many keys have these values now."""
    summed = changelog.groupBy("value").agg(F.sum("sign").alias("n")).where("n <> 0")
    return summed.select(F.from_json("value", schema).alias("v"), "n").select("v.*", "n")


def write_changes(changelog: DataFrame, table_path: str, checkpoint: str, available_now: bool = True):
    """Append the changelog as Parquet, exactly once."""
    writer = changelog.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
