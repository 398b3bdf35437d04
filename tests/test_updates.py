"""A stream's changelog sums up to a batch over the latest versions, whatever comes in whatever order."""

import random

import pandas as pd
from pyspark.sql import functions as F

from fathomline.streaming.updates import _follow, changes, current, write_changes


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_any_order_of_versions_gives_the_latest():
    rng = random.Random(1)
    for _ in range(200):
        rows = [(rng.randint(1, 4), rng.choice(["a", "b", None])) for _ in range(rng.randint(1, 8))]
        state, total = State(), {}
        at = 0
        while at < len(rows):
            n = rng.randint(1, 3)
            for out in _follow(("k",), iter([pd.DataFrame(rows[at : at + n], columns=["version", "value"])]), state):
                for r in out.itertuples():
                    total[r.value] = total.get(r.value, 0) + r.sign
            at += n
        latest = max(rows, key=lambda x: (x[0], x[1] is not None, x[1] or ""))[1]
        assert {k: n for k, n in total.items() if n} == ({latest: 1} if latest is not None else {})


def test_totals_after_updates_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 30)}", rng.randint(0, 5), rng.choice(["valid", "invalid"]), rng.randint(0, 3)) for _ in range(300)] + [(None, 1, "valid", 0), ("k1", None, "valid", 0)]
    df = spark.createDataFrame(rows, "path string, version int, outcome string, n int")
    for k in range(3):
        df.where(F.abs(F.hash("path", "n")) % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    followed = changes(stream.withColumnRenamed("n", "k"), "path", F.col("version"), ["outcome", "k"])
    for _ in range(2):  # the second time there is nothing new
        write_changes(followed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = current(spark.read.parquet(str(tmp_path / "out")), "outcome string, k int")
    best = df.where("path is not null and version is not null").withColumn("value", F.to_json(F.struct("outcome", F.col("n").alias("k")))).groupBy("path").agg(F.max_by(F.struct("outcome", "n"), F.struct("version", "value")).alias("v"))
    want = best.groupBy("v.outcome", "v.n").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
