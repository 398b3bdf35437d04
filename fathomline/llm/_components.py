"""Connected components of a table of links, by alternating large and small stars; and groups of rows as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import cut


class Union:
    """Sets of 0..n-1 that merge; the root of a set is its least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.sets = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.sets -= 1


def components(links: DataFrame, reduced: bool = False) -> DataFrame:
    """id, component for every id in links(a, b): component is the least id that links lead to.

    Each task first reduces its links to a spanning forest, unless a task that made them by forest() did so (reduced); then large and small stars alternate until nothing changes,
    each round's table written in the shared folder. Sums over a hub's links are combined before they are shuffled, and the
    joins with them carry one row per link, on whose hub side Spark splits a large partition. Rounds grow with the
    logarithm of the longest path. Links of an id with itself keep it as a component of its own."""
    links = links.select("a", "b")
    stars = cut((links if reduced else links.mapInArrow(forest, "a long, b long")).distinct(), "links")
    state = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = state(stars)
    rows = mark[0]
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(stars.where("a = b")).where("a > b or a = b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(low, "a").select(F.inline(pair))
        stars = cut(small.where("a > b").union(large.where("a = b")).distinct(), "stars", 2 * rows)
        before, mark = mark, state(stars)
        if mark == before:
            break
    ends = stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("id"), F.col("b").alias("component")))
    return ends.groupBy("id").agg(F.min("component").alias("component"))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every 200,000 links of a task, as few with the same components; the greater id first. A task that makes links
    in Python calls it there: a second MapInArrow would hold a second worker, and idle ones keep their memory."""
    held: list[np.ndarray] = []

    def reduced() -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate(held, axis=1) if held else np.empty((2, 0), np.int64), return_inverse=True)
        at = at.reshape(2, -1)
        sets = Union(len(ids))
        for a, b in zip(at[0].tolist(), at[1].tolist(), strict=True):
            sets.join(a, b)
        alone = np.zeros(len(ids), bool)
        alone[at[0][at[0] == at[1]]] = True
        root = np.array([sets.find(k) for k in range(len(ids))], dtype=np.int64)
        keep = (root != np.arange(len(ids))) | alone
        return pa.record_batch({"a": pa.array(ids[keep]), "b": pa.array(ids[root][keep] if len(ids) else ids)})

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(h.shape[1] for h in held) >= 200_000:
            yield reduced()
            held = []
    yield reduced()


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first `keys` columns, over batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group in one partition, one after another, for groups()."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
