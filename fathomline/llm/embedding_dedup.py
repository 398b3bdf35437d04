"""Embedding near-dedup: product quantisation over coarse inverted lists, then exact cosine.

A sample trains the coarse centroids, which grow in number with the square root of the rows, and, on residuals, the
subspace codebooks; every vector is indexed: its home list, residual codes, and the length of what the codes leave out.
A vector visits each list whose border with its home is near. Of two vectors at most e apart in different lists, one lies
within e/2 of the border between these, so visits up to e/2 find every pair whatever the vectors look like; less would
lose pairs that a border cuts, as borders run through large groups of near copies along their own noise. Table-lookup
distances are compared with e plus what the resident's codes leave out, so they lose no pair.

Groups of near copies are balls: vectors within e/2 of one point are all within e of one another, so each is linked with
all others of its ball, which are counted and not compared. Where the sample is dense it names such points; the vectors
of a ball form sub-lists of their lists, which the ball's own vectors don't visit.
Tasks count links and pass on spanning links, never pairs; large lists are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import Union, components, grouped, groups
from ._work import cut, sole, table


@dataclass(frozen=True)
class Plan:
    """threshold: least cosine; sample: vectors that train the index, at least, and a_list: for each list; parts: subspaces;
    least_ball: vectors of the sample that a ball needs; residents, queries: sides of a block; chunk: queries whose
    lookup tables are held at once."""

    threshold: float = 0.95
    sample: int = 20_000
    a_list: int = 16
    parts: int = 16
    least_ball: int = 8
    residents: int = 2048
    queries: int = 4096
    chunk: int = 256

    @property
    def reach(self) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * self.threshold)))

    @property
    def visit(self) -> float:
        """Distance to a border up to which a vector visits the list beyond; a pair at the very bound is not lost to rounding."""
        return self.reach / 2 + 1e-7

    def lists(self, rows: int) -> int:
        return max(1, int(rows**0.5))

    def trained_on(self, rows: int) -> int:
        """The sample's bound: it grows with the lists, the square root of the rows."""
        return max(self.sample, self.a_list * self.lists(rows))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids (fewer if x has fewer different rows), from a seeded choice of rows; an emptied one keeps its place."""
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    c = rows[np.sort(np.random.default_rng(seed).choice(len(rows), k, replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 4096] @ c.T - half).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


@dataclass
class Index:
    lists: np.ndarray
    books: np.ndarray  # part, entry, dimension of the part
    pivots: np.ndarray
    radius: float

    def balls(self, x: np.ndarray) -> np.ndarray:
        """The number of each vector's ball: of the first pivot that it is within the radius of; -1 for none."""
        if not len(self.pivots):
            return np.full(len(x), -1)
        square = np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ self.pivots.T) + (self.pivots**2).sum(axis=1))
        inside = square <= self.radius**2
        return np.where(inside.any(axis=1), inside.argmax(axis=1), -1)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list, codes and length of what they leave out, for unit vectors."""
        home = nearest(x, self.lists)
        rest = (x - self.lists[home]).reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)
        left = rest - self.books[np.arange(len(self.books)), codes]
        return home, codes, np.sqrt((left**2).sum(axis=(1, 2)))

    def visits(self, x: np.ndarray, home: np.ndarray, within: float) -> np.ndarray:
        """For each vector and list: whether the border between its home and that list is `within` reach. Its home is."""
        return self._near(x, home, self.lists, within)

    def visits_one(self, x: np.ndarray, home: int, others: np.ndarray, within: float) -> np.ndarray:
        """For each vector of one home whether it visits the list given for it."""
        which, at = np.unique(others, return_inverse=True)
        return self._near(x, np.full(len(x), home), self.lists[which], within)[np.arange(len(x)), at]

    def _near(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, within: float) -> np.ndarray:
        own, square = self.lists[home], (lists * lists).sum(axis=1)
        to_own = ((x - own) ** 2).sum(axis=1)
        farther = np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ lists.T) + square - to_own[:, None])
        apart = np.sqrt(np.maximum(0, (own * own).sum(axis=1)[:, None] - 2 * (own @ lists.T) + square))
        return farther <= 2 * within * apart + 1e-12


def train(x: np.ndarray, plan: Plan, rows: int) -> Index:
    """Lists for about `rows` vectors, codebooks on the residuals of the sample x (unit vectors)."""
    lists = k_means(x, max(1, min(plan.lists(rows), len(x) // 8)))
    parts = max(m for m in range(1, plan.parts + 1) if x.shape[1] % m == 0)
    rest = (x - lists[nearest(x, lists)]).reshape(len(x), parts, -1)
    books = [k_means(rest[:, m], 256) for m in range(parts)]
    books = np.stack([np.concatenate([b, np.repeat(b[:1], 256 - len(b), axis=0)]) for b in books])
    radius = max(0.0, plan.reach / 2 - 1e-7)
    return Index(lists, books, _pivots(x, nearest(x, lists), radius, plan.least_ball), radius)


def _pivots(x: np.ndarray, home: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Centres that have `least` vectors of the sample around them which no centre before has; the fullest first.

    Candidates come from the densest vector of each list, so a group that is spread over lists may get its centre from any:
    the mean of what is within twice the radius of that vector."""
    centres, inside = [], []
    order = np.argsort(home, kind="stable")
    square = (x * x).sum(axis=1)
    around = lambda c, r: np.flatnonzero(square - 2 * (x @ c) + c @ c <= r * r)
    for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        y = x[rows[:1024]]
        near = (square[rows[:1024], None] - 2 * (y @ y.T) + square[rows[:1024]] <= radius**2).sum(axis=1)
        if near.max(initial=0) > 1:
            centres.append(x[around(y[near.argmax()], 2 * radius)].mean(axis=0))
            inside.append(around(centres[-1], radius))
    free, chosen = np.ones(len(x), bool), []
    for k in sorted(range(len(centres)), key=lambda k: (-len(inside[k]), k)):
        if free[inside[k]].sum() >= least:
            chosen.append(centres[k])
            free[inside[k]] = False
    return np.array(chosen).reshape(-1, x.shape[1])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


INDEX = "id long, copies long, home int, ball int, codes binary, left double, vector binary"
ROWS = f"part int, one int, two int, list int, query boolean, {INDEX}"


def _lookups(x: np.ndarray, index: Index, here: int) -> np.ndarray:
    """Squared distances of each query's part to each entry of the codebooks: part, entry, query."""
    off = (x - index.lists[here]).reshape(len(x), len(index.books), -1).transpose(1, 2, 0)
    return ((index.books**2).sum(axis=2)[:, :, None] - 2 * (index.books @ off) + (off**2).sum(axis=1)[:, None, :]).astype(np.float32)


def _match(batches: Iterator[pa.RecordBatch], index: Index, plan: Plan) -> Iterator[pa.RecordBatch]:
    """For each group of (part of a list, block of residents, block of queries): id, linked, root, of each vector that links."""
    rows: list[tuple[int, int, int]] = []
    for g in groups(batches, 3):
        here = int(g.column("list")[0].as_py())
        asks = g.column("query").to_numpy()
        res, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(res) or not len(ask):
            continue
        ids, copies, home = (g.column(c).to_numpy() for c in ("id", "copies", "home"))
        x = np.frombuffer(b"".join(g.column("vector").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        codes = np.frombuffer(b"".join(g.column("codes").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[res].astype(np.intp)
        allow = ((plan.reach + 1e-4 + g.column("left").to_numpy()[res]) ** 2).astype(np.float32)
        linked = np.zeros(len(ids), dtype=np.int64)
        names, of = np.unique(ids, return_inverse=True)  # a resident may be a query of its own list
        sets = Union(len(names))
        for at in range(0, len(ask), plan.chunk):
            q = ask[at : at + plan.chunk]
            table_of = _lookups(x[q], index, here)
            d = table_of[0][codes[:, 0]]  # resident, query
            for m in range(1, len(table_of)):
                d += table_of[m][codes[:, m]]
            near = d <= allow[:, None]
            near &= (home[q] != here)[None, :] | (ids[q][None, :] < ids[res][:, None])
            b, a = np.nonzero(near)
            good = _cosines(x, q, res, a, b) >= plan.threshold
            a, b = q[a[good]], res[b[good]]
            # a pair of different lists is counted in the lower one, and in the higher if the other does not visit the lower
            other = home[a] < here
            if other.any():
                k = np.flatnonzero(other)
                visits = index.visits_one(x[b[k]], here, home[a[k]], plan.visit)
                keep = np.ones(len(a), bool)
                keep[k[visits]] = False
                a, b = a[keep], b[keep]
            if not len(a):
                continue
            np.add.at(linked, a, copies[b])
            np.add.at(linked, b, copies[a])
            root = np.array([sets.find(k) for k in range(len(names))])
            ra, rb = root[of[a]], root[of[b]]
            for pair in np.unique(np.minimum(ra, rb) * len(names) + np.maximum(ra, rb)).tolist():
                sets.join(pair // len(names), pair % len(names))
        total = np.bincount(of, linked, len(names)).astype(np.int64)
        rows += [(int(names[k]), int(total[k]), int(names[sets.find(int(k))])) for k in np.flatnonzero(total)]
        if len(rows) > 10_000:
            yield _linked(rows)
            rows = []
    yield _linked(rows)


def _cosines(x: np.ndarray, q: np.ndarray, res: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of the pairs (q[a], res[b]), summed one way however many there are."""
    return np.concatenate([np.einsum("ij,ij->i", x[q[a[k : k + 65536]]], x[res[b[k : k + 65536]]]) for k in range(0, len(a), 65536)] or [np.empty(0)])


def _linked(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return pa.record_batch({"id": pa.array(a[:, 0]), "linked": pa.array(a[:, 1]), "root": pa.array(a[:, 2])})


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan = Plan()) -> DataFrame:
    """A row per vector: id, n_links (other vectors with cosine >= threshold), component_id (least id that links lead to), kept.

    Vectors that are null, zero, hold nulls or non-finite numbers, or are of another length than most (of the longest of
    such lengths) link with nothing. Rows without an id are left out; of rows that repeat an id the one with the
    greatest vector counts. An empty table gives an empty one; further columns play no part. Equal vectors are indexed
    once and counted as often as they stand there."""
    spark = vectors.sparkSession
    base = sole(vectors, {"id": id_col, "v": vector_col}).where("id is not null").select(
        F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"),
    )
    if not base.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        base = base.groupBy("id").agg(F.max("v").alias("v"))
    most = base.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("n")).first()
    alone = base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if most is None:
        return alone.withColumn("kept", F.lit(True)).withColumnRenamed("id", id_col)
    dim = most["n"]
    sound = F.coalesce(
        (F.size("v") == dim) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0),
        F.lit(False),
    )
    classes = cut(base.where(sound).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    count_of = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(plan.trained_on(count_of)).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return alone.withColumn("kept", F.lit(True)).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(train(_unit(_vectors(sample, dim)), plan, count_of))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _unit(_vectors(part.column("v"), dim))
                home, codes, left = shared.value.code(x)
                yield pa.record_batch({
                    "id": part.column("id"), "copies": part.column("copies"), "home": pa.array(home.astype(np.int32)), "ball": pa.array(shared.value.balls(x).astype(np.int32)), "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                    "left": pa.array(left), "vector": pa.array([v.tobytes() for v in x], pa.binary()),
                })

    indexed = cut(classes.mapInArrow(index, INDEX), "index")

    def visits(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of rows and of the lists that they ask, their home among them."""
        x = np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=np.float64).reshape(part.num_rows, -1)
        return np.nonzero(shared.value.visits(x, part.column("home").to_numpy(), plan.visit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By list and ball: residents, and the ball's own vectors that ask the list."""
        width = len(shared.value.pivots) + 1
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ball = part.column("ball").to_numpy().astype(np.int64) + 1
                row, lists = visits(part)
                keys, n = np.unique(np.concatenate([part.column("home").to_numpy() * width + ball, lists * width + ball[row]]), return_inverse=True)
                homes, asked = (np.bincount(k, minlength=len(keys)) for k in (n[: len(ball)], n[len(ball) :]))
                yield pa.record_batch({"list": pa.array(keys // width), "ball": pa.array(keys % width - 1), "residents": pa.array(homes), "own": pa.array(asked)})

    sizes = indexed.mapInArrow(count, "list long, ball long, residents long, own long").groupBy("list", "ball").agg(
        F.sum("residents").alias("residents"), F.sum("own").alias("own"),
    )
    asked = sizes.groupBy("list").agg(F.sum("own").alias("asked"))
    sizes = sizes.where("residents > 0").join(asked, "list").orderBy("list", "ball").toPandas()
    queries = sizes["asked"].to_numpy() - np.where(sizes["ball"].to_numpy() >= 0, sizes["own"].to_numpy(), 0)
    first = np.searchsorted(sizes["list"].to_numpy(), np.arange(len(shared.value.lists) + 1))
    sides = (np.maximum(1, -(-n // side)) for n, side in ((sizes["residents"].to_numpy(), plan.residents), (queries, plan.queries)))
    parts = spark.sparkContext.broadcast((first, sizes["ball"].to_numpy(), *sides))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as a resident of its home's part, for every block of queries, and as a query of the parts of each list
        that it asks but those of its own ball, for every block of residents."""
        first, ball_of, r, q = parts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                ids, home, ball = rows.column("id").to_numpy().astype(np.uint64), rows.column("home").to_numpy(), rows.column("ball").to_numpy()
                spread = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                row, mine = _repeated(np.arange(len(ids)), first[home], first[home + 1])
                keep = ball_of[mine] == ball[row]
                row, two = _repeated(row[keep], np.zeros(keep.sum(), int), q[mine[keep]])
                mine = np.repeat(mine[keep], q[mine[keep]])
                yield _dealt(rows, row, mine, home[row], spread[row] % r[mine], two, False)
                vrow, vlist = visits(rows)
                at_, asks = _repeated(np.arange(len(vrow)), first[vlist], first[vlist + 1])
                keep = (ball_of[asks] != ball[vrow[at_]]) | (ball[vrow[at_]] < 0)
                at_, asks = at_[keep], asks[keep]
                n = r[asks]
                where, one = _repeated(np.arange(len(asks)), np.zeros(len(asks), int), n)
                row, lists, asks = vrow[at_[where]], vlist[at_[where]], asks[where]
                for a in range(0, len(row), 8192):
                    s = slice(a, a + 8192)
                    yield _dealt(rows, row[s], asks[s], lists[s], one[s], spread[row[s]] % q[asks[s]], True)

    dealt = grouped(indexed.mapInArrow(deal, ROWS), ["part", "one", "two"])
    found = cut(dealt.mapInArrow(lambda b: _match(b, shared.value, plan), "id long, linked long, root long"), "links")
    members = indexed.where("ball >= 0").select("id", "ball", "copies")
    balls = F.broadcast(members.groupBy("ball").agg(F.min("id").alias("root"), F.sum("copies").alias("all")))  # as many as pivots, at most
    found = found.union(members.join(balls, "ball").select("id", (F.col("all") - F.col("copies")).alias("linked"), "root"))
    within = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    each = found.groupBy("id").agg(F.sum("linked").alias("linked")).join(within, "id", "left").withColumnRenamed("id", "class_id")
    final = classes.select("v", F.col("id").alias("class_id"), "copies").join(each, "class_id", "left")
    done = base.select("id", F.when(sound, F.col("v")).alias("v")).join(final, "v", "left").select(
        "id", F.coalesce(
            F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0),
        ).cast("long").alias("n_links"), F.coalesce("component", "class_id", "id").alias("component_id")
    )
    return done.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)


def _repeated(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of x once for every number from its start up to its end, and these numbers."""
    n = end - start
    return np.repeat(x, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)


def _dealt(
    rows: pa.RecordBatch, row: np.ndarray, part: np.ndarray, lists: np.ndarray, one: np.ndarray, two: np.ndarray,
    query: bool,
) -> pa.RecordBatch:
    taken = rows.take(pa.array(row))
    keys = {k: pa.array(v.astype(np.int32)) for k, v in (("part", part), ("one", one), ("two", two), ("list", lists))}
    return pa.record_batch({**keys, "query": pa.array(np.full(len(row), query)), **{c: taken.column(c) for c in taken.schema.names}})


#: Links of all pairs by double-precision cosine, and what they lead to.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND list_count(e) = len(e) AND len(list_filter(e, lambda x: isfinite(x))) = len(e)
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
