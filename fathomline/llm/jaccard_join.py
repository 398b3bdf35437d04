"""N-gram Jaccard join: a chosen-path join over MinHash coordinates, then exact Jaccard on the shingles.

Sets are embedded by MinHash: coordinate k of a set is a token, and two sets share it with their Jaccard similarity as
probability. A run splits all sets into buckets by the tokens at a few sampled coordinates; a bucket that is small is
compared by brute force on short signatures, a larger one is split again by coordinates sampled from its own path, until
it is small or splitting no longer thins it, as with a group of near copies, which is compared in blocks. Runs are
independent of one another and go side by side, as many as it takes until a pair at the threshold is missed with less
than the allowed probability. Tasks pass on spanning links of what they find, never pairs. Within the components of
these candidates the exact similarity of all pairs is taken, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import Union, components, forest, grouped, groups
from ._words import NOT_SPACE, mix, slices, windows, words
from ._work import P, cut, join_counted, sifted, sole, table


@dataclass(frozen=True)
class Plan:
    """size: words of a shingle; threshold: least similarity; coordinates, chosen, split: in all, sampled by a run, and sampled where
    a bucket is split; small: sets of a bucket that is not split; block: sets of a side of a larger bucket; depth: splits of a run;
    slack: how far below the threshold a signature's estimate may lie (five standard errors, which a pair at the threshold
    exceeds with a probability below 1e-6); exact_sets, exact_shingles: of a side of a block of exact comparisons, at most about;
    recall: of a pair at the threshold, before slack."""

    size: int = 5
    threshold: float = 0.8
    signature: int = 128
    coordinates: int = 32
    chosen: int = 3
    split: int = 2
    small: int = 512
    block: int = 2048
    exact_sets: int = 1024
    exact_shingles: int = 1 << 18
    depth: int = 4
    slack: float = 0.18
    recall: float = 0.999999

    @property
    def runs(self) -> int:
        """A path survives a split if it is taken at one of the sampled coordinates and survives below; a run misses a pair if all its paths end."""
        lives = 1.0
        for _ in range(self.depth):
            lives = 1 - (1 - self.threshold * lives) ** self.split
        return max(2, math.ceil(math.log(1 - self.recall) / (self.chosen * math.log(max(1e-9, 1 - self.threshold * lives)))))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of `size` lower-cased words between white space; a text of fewer
    words has one shingle of all its words, a text without words none."""
    w = words([t.lower() for t in texts], NOT_SPACE)
    hashed, at = windows(w.hash, w.doc, size)
    bounds = np.searchsorted(w.doc[at], np.arange(len(texts) + 1)) if len(at) else np.zeros(len(texts) + 1, int)
    sets = [np.unique(hashed[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    counts = np.bincount(w.doc, minlength=len(texts)) if len(w.doc) else np.zeros(len(texts), int)
    first = np.concatenate([[0], np.cumsum(counts)])
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own, _ = windows(w.hash[first[d] : first[d + 1]], np.zeros(counts[d], int), int(counts[d]))
        sets[d] = mix(own + np.uint64(counts[d]))
    return sets


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:n] | np.uint64(1), seeds[n:]


def sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    """id, version (hash of the text), d1, d2 (digest of the set), n (its size), tokens (coordinates), sig (a byte a coordinate); of texts without words n is 0 and the rest null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(plan.signature)
        for batch in batches:
            for base, texts in slices(batch.column("t")):
                sets = shingle_sets(texts, plan.size)
                own = batch.slice(base, len(texts)).select(["id", "version"])
                has = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
                if len(blank := np.array([k for k, s in enumerate(sets) if not len(s)], dtype=np.int64)):
                    part = own.take(pa.array(blank))
                    kinds = {"d1": pa.int64(), "d2": pa.int64(), "tokens": pa.list_(pa.int64()), "sig": pa.binary()}
                    none = {k: pa.nulls(len(blank), kind) for k, kind in kinds.items()}
                    yield pa.record_batch({"id": part.column("id"), "version": part.column("version"), "d1": none["d1"], "d2": none["d2"], "n": pa.array(np.zeros(len(blank), np.int32)), "tokens": none["tokens"], "sig": none["sig"]})
                if not len(has):
                    continue
                own = own.take(pa.array(has))
                all_, sizes = np.concatenate([sets[k] for k in has]), np.array([len(sets[k]) for k in has])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                with np.errstate(over="ignore"):
                    least = np.stack([np.minimum.reduceat(all_ * m + c, at) for m, c in zip(a, b, strict=True)], axis=1)
                    d1, d2 = np.add.reduceat(all_, at), np.add.reduceat(mix(all_ ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                tokens = np.ascontiguousarray(least[:, : plan.coordinates]).view(np.int64)
                sig = np.ascontiguousarray((mix(least) >> np.uint64(56)).astype(np.uint8))
                step = lambda k: pa.array((np.arange(len(has) + 1) * k).astype(np.int32))
                yield pa.record_batch({
                    "id": own.column("id"), "version": own.column("version"), "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64)), "n": pa.array(sizes.astype(np.int32)),
                    "tokens": pa.ListArray.from_arrays(step(plan.coordinates), pa.array(tokens.ravel())),
                    "sig": pa.Array.from_buffers(pa.binary(), len(has), [None, step(plan.signature).buffers()[1], pa.py_buffer(sig.tobytes())]),
                })

    return docs.mapInArrow(run, "id long, version long, d1 long, d2 long, n int, tokens array<long>, sig binary")


def _similar(sigs: np.ndarray, n: np.ndarray, left: int, plan: Plan, sets: Union) -> None:
    """Join sets whose estimate may reach the threshold: all pairs, or, with left > 0, those of a row before and one from left on.

    Stops as soon as all are one set."""
    need = (plan.threshold - plan.slack) * sigs.shape[1]
    for k in range(left or len(sigs)):
        if sets.sets == 1:
            return
        rest = slice(left or k + 1, len(sigs))
        same = np.count_nonzero(sigs[rest] == sigs[k], axis=1)
        fits = (same >= need) & (np.minimum(n[rest], n[k]) >= (plan.threshold - 1e-9) * np.maximum(n[rest], n[k]))
        for j in np.flatnonzero(fits):
            sets.join(k, rest.start + int(j))


def _compare(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of what is similar within each group of (key, one, two, id, n, sig, side)."""
    out_a: list[int] = []
    out_b: list[int] = []
    for g in groups(batches, 3):
        order = np.lexsort((g.column("id").to_numpy(), g.column("side").to_numpy()))
        ids, n, side = (g.column(c).to_numpy()[order] for c in ("id", "n", "side"))
        sigs = np.frombuffer(b"".join(g.column("sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
        sets = Union(len(ids))
        _similar(sigs, n, int((side == 0).sum()) if side[-1] else 0, plan, sets)
        for k in range(len(ids)):
            if (root := sets.find(k)) != k:
                out_a.append(int(ids[k]))
                out_b.append(int(ids[root]))
        if len(out_a) > 10_000:
            yield pa.record_batch({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
            out_a, out_b = [], []
    yield pa.record_batch({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _in_blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of its key's so many blocks that its own block is in: columns one, two, side. Blocks are dealt by a hash of the id."""
    own = F.pmod(F.xxhash64("id", F.col(key)), F.col(P + "k")).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), F.col(P + "k") - 1)).alias(P + "o")
    dealt = rows.withColumn(P + "k", blocks.cast("int")).withColumn(P + "b", own).select("*", pairs)
    one, two = F.least(P + "b", P + "o").alias("one"), F.greatest(P + "b", P + "o").alias("two")
    return dealt.select(*rows.columns, one, two, (F.col(P + "b") > F.col(P + "o")).cast("int").alias("side"))


def _candidates(reps: DataFrame, count: int, plan: Plan) -> DataFrame:
    """Candidate links (a, b) of all runs over so many reps, of each task a spanning forest."""
    first = [F.xxhash64(F.lit(k), F.col("tokens")[k % plan.coordinates]) for k in range(plan.runs * plan.chosen)]
    nodes, total = reps.select("id", F.explode(F.array(*first)).alias("key")).withColumn("before", F.lit(None).cast("long")), count * len(first)
    done: DataFrame | None = None
    for level in range(plan.depth + 1):
        sizes = cut(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bucket-sizes", total)
        sized = cut(join_counted(nodes, sizes, ["key"], "m", total), "buckets", total)
        stop = (F.col("m") <= plan.small) | (F.col("m") > F.col("before") / 2) if level < plan.depth else F.lit(True)
        stop = F.coalesce(stop, F.col("m") <= plan.small)
        ready = sized.where(stop).select("key", "id", "m")
        done = ready if done is None else done.union(ready)
        large = sized.where(~stop)
        if level == plan.depth or not (left := large.count()):
            break
        total = left * plan.split
        picks = [F.pmod(F.xxhash64("key", F.lit(j)), F.lit(plan.coordinates)).cast("int") for j in range(plan.split)]
        split = F.explode(F.array_distinct(F.array(*[F.xxhash64("key", p, F.col("tokens")[p]) for p in picks])))
        nodes = large.join(reps.select("id", "tokens"), "id").select("id", split.alias("key"), F.col("m").alias("before"))
        nodes = cut(nodes, "split-buckets", total)  # counted and joined below: read three times, made once
    rows = _in_blocks(done, "key", F.ceil(F.col("m") / plan.block)).join(reps.select("id", "n", "sig"), "id").select("key", "one", "two", "id", "n", "sig", "side")
    return grouped(rows, ["key", "one", "two"]).mapInArrow(lambda b: forest(_compare(b, plan)), "a long, b long")


def _exact(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """For each group of (key, one, two, id, copies, shingles, side): a row for each linked id: id, linked (copies of what it links), root."""
    rows: list[tuple[int, int, int]] = []
    for g in groups(batches, 3):
        order = np.lexsort((g.column("id").to_numpy(), g.column("side").to_numpy()))
        order = order[np.unique(g.column("id").to_numpy()[order], return_index=True)[1]]  # a text that stands there twice counts by its copies
        order = order[np.argsort(g.column("side").to_numpy()[order], kind="stable")]
        ids, copies, side = (g.column(c).to_numpy()[order] for c in ("id", "copies", "side"))
        raw = g.column("shingles").to_pylist()
        held = [np.frombuffer(raw[k], dtype=np.uint64) for k in order]
        linked = _links(held, int((side == 0).sum()) if side[-1] else 0, plan.threshold)
        sets = Union(len(ids))
        for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
            if sets.sets == 1:
                break
            sets.join(int(a), int(b))
        totals = linked @ copies
        rows += [(int(ids[k]), int(totals[k]), int(ids[sets.find(k)])) for k in np.flatnonzero(totals)]
        if len(rows) > 10_000:
            yield _linked(rows)
            rows = []
    yield _linked(rows)


def _linked(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return pa.record_batch({"id": pa.array(a[:, 0]), "linked": pa.array(a[:, 1]), "root": pa.array(a[:, 2])})


def _links(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold: of all, or, with left > 0, of one before and one from left on."""
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.float64)
    shared = np.zeros((m, m))
    owner = np.repeat(np.arange(m), n.astype(int))
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[code]
    owner, code = owner[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    step = max(512, (1 << 21) // m)
    for at in range(0, int(often.sum()), step):
        a, b = np.searchsorted(code, [at, at + step])
        part = np.zeros((m, min(step, int(often.sum()) - at)), dtype=np.float32)
        part[owner[a:b], code[a:b] - at] = 1
        shared += part @ part.T
    linked = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if left:
        linked[:left, :left] = False
        linked[left:, left:] = False
    return linked


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """A row per row of docs with an id: id, version (xxhash64 of the text), class_id (least id with the same shingles),
    n_links (other rows at the threshold or above, those of the same class among them), component_id (least id that
    links lead to), kept (one row of each component, with that id).

    Null, empty and blank texts have no shingles: they link with nothing and are a class each. Rows without an id are
    left out. Rows that repeat an id are compared one by one, with equal or other texts. An empty table gives an empty
    one; further columns of docs play no part."""
    base = sole(docs, {"id": id_col, "t": text_col}).where("id is not null").select(
        F.col("id").cast("long").alias("id"), F.coalesce("t", F.lit("")).alias("t"),
    )
    base = base.withColumn("version", F.xxhash64("t"))
    made = cut(sketch(base, plan).withColumn("row", F.monotonically_increasing_id()), "sketches")
    lead = F.min(F.struct(F.col("id").alias("doc"), F.col("row").alias("id"), "version"))
    digest = ["d1", "d2", "n"]
    classes = made.where("n > 0").groupBy(*digest).agg(
        lead.alias(P + "lead"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"),
        F.first("sig").alias("sig"),
    )
    classes = cut(classes.select(*digest, P + "lead.*", "copies", "tokens", "sig"), "classes")
    reps, count = classes.select("id", "n", "tokens", "sig"), classes.count()
    label = cut(components(_candidates(reps, count, plan), reduced=True), "components", count)
    sides = F.greatest(F.ceil(F.count(F.lit(1)) / plan.exact_sets), F.ceil(F.sum("n") / plan.exact_shingles)).alias("blocks")
    named = label.withColumnRenamed("component", "key").join(classes.select("id", "n", "doc", "version", "copies"), "id")
    sizes = cut(named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), sides), "sizes", count)
    members = cut(join_counted(named, sizes, ["key"], "m", count).select("key", "blocks", "id", "doc", "version", "copies"), "members", count)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("t")):
                sets = [s.tobytes() for s in shingle_sets(texts, plan.size)]
                part = batch.slice(at, len(texts))
                yield pa.record_batch({**{c: part.column(c) for c in ("key", "blocks", "id", "copies")}, "shingles": pa.array(sets, pa.binary())})

    texts = sifted(
        base.withColumnRenamed("id", "doc"), members, ["doc", "version"],
    ).join(members, ["doc", "version"]).select("key", "blocks", "id", "copies", "t")
    sets = texts.mapInArrow(shingles, "key long, blocks long, id long, copies long, shingles binary")
    blocks = _in_blocks(sets, "key", F.col("blocks")).select("key", "one", "two", "id", "copies", "shingles", "side")
    found = cut(grouped(blocks, ["key", "one", "two"]).mapInArrow(lambda b: _exact(b, plan), "id long, linked long, root long"), "links")
    within = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    each = found.groupBy("id").agg(F.sum("linked").alias("linked")).join(within, "id").join(classes.select("id", "doc"), "id")
    first = each.groupBy("component").agg(F.min(F.struct("doc", "id")).alias(P + "first"), F.count(F.lit(1)).alias("m"))
    each = join_counted(each.drop("doc"), first, ["component"], "m", count).select(
        "id", "linked", F.col(P + "first.doc").alias("component_id"), F.col(P + "first.id").alias("keeper"),
    )
    final = cut(classes.select(*digest, "id", F.col("doc").alias("class_id"), "copies").join(each, "id", "left"), "final", count)
    mine = join_counted(made.where("n > 0").select(F.col("id").alias("doc"), "version", "row", *digest), final, digest, "copies", made.count())
    links = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    linked = mine.select(
        F.col("doc").alias(id_col), "version", "class_id", links,
        F.coalesce("component_id", "class_id").alias("component_id"),
        (F.col("row") == F.coalesce("keeper", "id")).alias("kept"),
    )
    blank = made.where("n = 0").select(
        F.col("id").alias(id_col), "version", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("id").alias("component_id"), F.lit(True).alias("kept"),
    )
    return linked.union(blank)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all documents, in which an id has one row; its version is not returned."""
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("version")


#: All pairs that share a shingle, their exact similarity, and what the links lead to.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM w),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + 4], ' ')) AS g FROM i),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b, k = ca.n AND k = cb.n AS same FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE k >= 0.8 * (ca.n + cb.n - k) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n, min(b) FILTER (same) AS c FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(c, doc_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links,
       least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN n ON n.a = doc_id LEFT JOIN least ON least.a = doc_id
"""
