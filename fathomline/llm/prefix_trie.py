"""Conversation prefix trie: every distinct opening of conversations as a node, named after the least conversation that opens so.

If a conversation is the least with its first d turns, it is so with more of them too: it owns its openings from some depth
on. That depth is found by binary search, for all conversations at once: each round joins the digest of one opening of
each with the table of digests and their least conversations. What a conversation owns is a chain of nodes; chains hang on
nodes of others. Sums over subtrees go up the tree of chains by pointers that double their reach each round, then along
each chain from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._order import ordered, running
from ._work import cut, join_counted, sole, table
from .resampling import CRC, CRC_TABLE

#: What parts the words of a text.
WORD = "[^\\x20\\x09-\\x0D]+"
EMPTY = hashlib.sha256().hexdigest()


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.octet_length(p) for p in parts], *parts).cast("binary"))


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c, i (0, 1, ...), m (digest of role and text), words of each turn: by turn, null first, ties by role, then text.

    Null roles and texts are empty ones; rows without a conversation are left out. Texts move once, by ranges of the order."""
    turns = sole(conversations, {"c": conv_col, "t": turn_col, "r": role_col, "x": text_col}).where("c is not null")
    turns = turns.select(F.col("c").cast("long").alias("c"), "t", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("r", "x")])
    turns = turns.withColumns({"m": _digest(F.col("r"), F.col("x")), "words": F.regexp_count("x", F.lit(WORD)).cast("long"), "one": F.lit(1).cast("long")})
    placed = ordered(turns, ["c", F.asc_nulls_first("t"), "r", "x"], ["c", "m", "words", "one"], "turns")
    return running(placed, ["c"], {"i": ("sum", "one")}).select("c", F.col("i") - 1, "m", "words").toDF("c", "i", "m", "words")


def lengths(turns: DataFrame) -> DataFrame:
    """c, n of each conversation that has turns."""
    return turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over numbered turns (c, i, m, words) and convs (c, n; n turns each, none too).

    Per node: conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. An opening is known by 128 bits: the XOR of an MD5 of each place and what stands there.
    Without conversations there is no node, not even a root; conversations without turns end at the root."""
    place = F.md5(F.concat_ws(":", (F.col("i") + 1).cast("string"), "m").cast("binary"))
    half = lambda k: F.conv(F.substring(place, k, 16), 16, -10).cast("long")
    last = join_counted(turns, convs, ["c"], "n", turns.count()).select("c", (F.col("i") + 1).alias("d"), half(1).alias("a"), half(17).alias("b"), "words", (F.col("i") + 1 == F.col("n")).alias("last"))
    placed = ordered(last, ["c", "d"], last.columns, "places")
    openings = cut(running(placed.withColumnsRenamed({"a": "a1", "b": "b1"}), ["c"], {"a": ("xor", "a1"), "b": ("xor", "b1")}).select("c", "d", "a", "b", "words", "last"), "openings")
    least = F.min(F.struct("c", "last"))
    minima = openings.groupBy("d", "a", "b").agg(least.alias("least"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words"))
    minima = cut(minima.select("d", "a", "b", F.col("least.c").alias("owner"), F.col("least.last").alias("last"), "n", "words"), "minima")
    n_convs, root, longest = convs.agg(F.count(F.lit(1)), F.min("c"), F.max("n")).first()

    def owned(rows: DataFrame, depth: str) -> DataFrame:
        """rows of conversations c with `owner` of their opening of that depth (over 0)."""
        at = rows.join(openings.select("c", F.col("d").alias(depth), "a", "b"), ["c", depth])
        return join_counted(at, minima.select(F.col("d").alias(depth), "a", "b", "owner", "n"), [depth, "a", "b"], "n", n_convs).select(*rows.columns, "owner")

    # lo: a depth from which on, if at all, c owns its openings; hi: one from which on it does (one past the end: none)
    found = cut(convs.select("c", F.col("n").alias("length"), F.lit(1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi")), "chains")
    for _ in range((longest or 0).bit_length()):
        open_ = owned(found.where("lo < hi").withColumn("mid", F.expr("(lo + hi) div 2")), "mid")
        own = F.col("owner") == F.col("c")
        moved = open_.select("c", "length", F.when(own, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(own, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        found = cut(moved.union(found.where("lo = hi")), "chains")
    # f: the depth of the first node of c's own; p: whose the node above it is
    first = found.select("c", "length", F.when(F.col("c") == root, 0).otherwise(F.col("lo")).cast("long").alias("f"))
    deep = owned(first.where("f > 1").withColumn("up", F.col("f") - 1), "up").select("c", "length", "f", F.col("owner").alias("p"))
    top = first.where("f <= 1").select("c", "length", "f", F.when(F.col("f") == 1, F.lit(root)).alias("p"))
    chains = cut(deep.union(top), "chains")

    owners = minima.select(F.col("owner").alias("c"), "d", "n", "words", "last")
    rooted = convs.where(F.col("c") == root).select("c", F.lit(0).cast("long").alias("d"), F.lit(n_convs).cast("long").alias("n"), F.lit(0).cast("long").alias("words"), (F.col("n") == 0).alias("last"))
    hung = chains.where("f <= length and p is not null")
    count = hung.groupBy(F.col("p").alias("c"), (F.col("f") - 1).alias("d")).agg(F.count(F.lit(1)).alias("hung"))
    nodes = owners.union(rooted).join(count, ["c", "d"], "left").withColumn("n_children", F.coalesce("hung", F.lit(0)) + (~F.col("last")).cast("long"))
    nodes = nodes.select("c", "d", "n", "n_children", ((F.col("n") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    nodes = cut(nodes, "nodes")

    sums = _up(hung, nodes.groupBy("c").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")))
    below = sums.where("p is not null").groupBy(F.col("p").alias("c"), (F.col("f") - 1).alias("d")).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaf"))
    more = lambda k: (F.col(k) + F.coalesce(f"more_{k}", F.lit(0))).alias(k)
    whole = nodes.join(below, ["c", "d"], "left").select("c", "d", "n", "n_children", more("saved"), more("leaf"))
    from_end = ordered(whole, ["c", F.desc("d")], whole.columns, "subtrees")
    done = running(from_end, ["c"], {"saved_tokens": ("sum", "saved"), "n_leaves": ("sum", "leaf")})
    parent = hung.select("c", F.col("f").alias("d"), "p")
    ends = ended(chains.select(F.when(F.col("f") <= F.col("length"), F.col("c")).otherwise(F.col("p")).alias("c"), F.col("length").alias("d"), F.col("c").alias("member")))
    return done.join(parent, ["c", "d"], "left").join(ends, ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > 0, F.coalesce("p", "c")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _up(hung: DataFrame, own: DataFrame) -> DataFrame:
    """c, p, f, saved, leaf of each chain: own's sums with those of all chains below it.

    After k rounds a chain has the sums of chains less than 2**k steps below, and a pointer to the one 2**k steps above."""
    sums = cut(own.join(hung.select("c", "p", "f"), "c", "left").select("c", "p", "f", F.col("p").alias("up"), "saved", "leaf"), "chain-sums")
    while n := sums.where("up is not null").count():
        rising = sums.where("up is not null")
        got = rising.groupBy(F.col("up").alias("c")).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaf"), F.count(F.lit(1)).alias("n"))
        got = cut(got.join(sums.select("c", F.col("up").alias("next")), "c"), "chain-steps")
        # every chain's next pointer is that of the chain it points to
        moved = join_counted(rising.select(F.col("c").alias("d"), "up"), got.select(F.col("c").alias("up"), "next", "n"), ["up"], "n", n).select(F.col("d").alias("c"), "next")
        more = lambda k: (F.col(k) + F.coalesce(f"more_{k}", F.lit(0))).alias(k)
        taken = sums.join(got.drop("next", "n"), "c", "left").select("c", "p", "f", more("saved"), more("leaf"))
        sums = cut(taken.join(moved, "c", "left").select("c", "p", "f", F.col("next").alias("up"), "saved", "leaf"), "chain-sums")
    return sums


def ended(members: DataFrame) -> DataFrame:
    """c, d, ends_sha256: SHA-256 of the ids of each node's (c, d) members, in order, joined by commas.

    Ids are joined into pieces where ranges of (node, id) lie, so the task that hashes a node reads few rows; it holds one piece at a time."""
    order = ["c", "d", "member"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_joined, "c long, d long, first long, ids string")
    return pieces.repartition("c", "d").sortWithinPartitions("c", "d", "first").mapInArrow(_hashed, "c long, d long, ends_sha256 string")


#: Ids in a piece.
PIECE = 8192


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, held, out = None, [], []

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.int64(),) * 3 + (pa.string(),), strict=True)], ["c", "d", "first", "ids"])

    def close() -> None:
        if held:
            out.append((*node, held[0], ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        for c, d, member in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (c, d) != node or len(held) == PIECE:
                close()
                node = (c, d)
            held.append(member)
        yield made()
        out = []
    close()
    yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state, out = None, None, []

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["c", "d", "ends_sha256"])

    for batch in batches:
        for c, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (c, d) == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (c, d), hashlib.sha256()
            state.update(ids.encode())
        yield made()
        out = []
    if node:
        out.append((*node, state.hexdigest()))
    yield made()


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (as prefix_trie() takes them) of conversations that share openings: the first h turns of conversation
    c - c % group, then c's own turns after its first h; h is the CRC-32 of c's digits modulo `most`."""
    convs = cut(lengths(turns), "lengths")
    h = F.crc32(F.col("c").cast("string")) % most
    base = F.col("c") - F.col("c") % group
    heads = turns.where((F.col("c") % group == 0) & (F.col("i") < most - 1)).select(F.col("c").alias("base"), "i", "m", "words")
    had = heads.groupBy("base").agg(F.count(F.lit(1)).alias("had"))
    known = convs.select("c", "n", h.alias("h"), base.alias("base")).join(had, "base", "left")
    known = cut(known.select("c", "n", "h", "base", F.least("h", F.coalesce("had", F.lit(0))).cast("long").alias("k")), "rebuilt")
    opening = known.join(heads, "base").where("i < h").select("c", "i", "m", "words")
    own = join_counted(turns, known.select("c", "n", "h", "k"), ["c"], "n", turns.count()).where("i >= h").select("c", (F.col("k") + F.col("i") - F.col("h")).alias("i"), "m", "words")
    return cut(opening.union(own), "rebuilt-turns"), known.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """prefix_trie() of a table of turns as numbered() reads it. The turn at a node's depth in conversation conv_id is the node's own."""
    turns = cut(numbered(conversations, **columns), "numbered")
    return prefix_trie(turns, lengths(turns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(numbered(table(spark, sf_dir, "conversations")), "numbered")
    return prefix_trie(*rebuilt(turns))


OP13_SQL = f"""
WITH rests AS ({CRC_TABLE}),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, {CRC.format(s="c::VARCHAR")} % 4 AS h
      FROM (SELECT DISTINCT c FROM t), rests),
u AS (SELECT v.c, 0 AS part, i, role, text FROM v JOIN t ON t.c = v.c - v.c % 20 AND i < h
      UNION ALL SELECT v.c, 1, i, role, text FROM v JOIN t USING (c) WHERE i >= h),
o AS (SELECT c, list({{'r': role, 't': text}} ORDER BY part, i) AS turns FROM u GROUP BY c),
r AS (SELECT v.c, coalesce(turns, []) AS turns FROM v LEFT JOIN o USING (c)),
p AS (SELECT c, d, sha256(turns[1:d]::JSON::VARCHAR) AS k, sha256(turns[1:d - 1]::JSON::VARCHAR) AS up, d = len(turns) AS ends,
        CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
      FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
w AS (SELECT x.*, y.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.d = x.d + 1 AND z.up = x.k) AS n_children
      FROM n x LEFT JOIN n y ON x.d > 0 AND y.d = x.d - 1 AND y.k = x.up),
s AS (SELECT q.d, q.k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM (SELECT DISTINCT p.d, p.k, l.d AS ld, l.k AS lk, l.saved, (l.n_children = 0)::INT AS leaf
            FROM w l JOIN p m ON m.c = l.conv_id AND m.d = l.d JOIN p ON p.c = m.c AND p.d <= m.d) q GROUP BY q.d, q.k)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM w JOIN s USING (d, k)
"""
