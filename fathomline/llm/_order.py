"""Total orders and running sums over tables of any size: no key, however hot, is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import P, cut

AT, PART = P + "at", P + "part"
#: Sums that can be put together from those of parts.
SUMS = {"sum": (F.sum, lambda a, b: a + b, 0), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0)}


def ordered(df: DataFrame, order: list[Column | str], keep: list[str], name: str) -> DataFrame:
    """The columns `keep` of df's rows, each with its place (AT: rises along the order; PART: the partition it was sorted in), written once.

    Rows are dealt out by ranges of the whole order, so equal values of its first columns may lie in several parts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return cut(placed.select(*keep, AT, F.shiftright(AT, 33).cast("int").alias(PART)), name)


def running(placed: DataFrame, by: list[str], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """placed (of ordered(), whose order begins with `by`; no column of `by` is null) with running sums along each key's rows,
    the row itself included. sums: {new column: (a name of SUMS, column)}.

    Sums run within the rows of a key in one part. What a key's earlier parts hold is added by a broadcast: as the parts
    are ranges, a part opens with the rest of one key at most, so that table has fewer rows than there are parts."""
    along = Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    made = {c: (*SUMS[kind], of) for c, (kind, of) in sums.items()}
    totals = placed.groupBy(*by, PART).agg(*[total(of).alias(c) for c, (total, _, _, of) in made.items()])
    before = totals.select(*by, PART, F.count(F.lit(1)).over(earlier).alias(P + "parts"), *[total(c).over(earlier).alias(P + c) for c, (total, _, _, _) in made.items()])
    before = before.where(F.col(P + "parts") > 0).drop(P + "parts")
    inside = placed.select("*", *[total(of).over(along).alias(c) for c, (total, _, _, of) in made.items()])
    whole = {c: put(F.col(c), F.coalesce(F.col(P + c), F.lit(none))) for c, (_, put, none, _) in made.items()}
    return inside.join(F.broadcast(before), [*by, PART], "left").select(*placed.columns, *[x.alias(c) for c, x in whole.items()])
