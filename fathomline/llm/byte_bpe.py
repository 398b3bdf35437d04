"""Byte-level BPE: the tokenizers library over Arrow batches; ids, offsets, and decoding through the byte table.

A text is cut into the pattern's matches; each distinct match goes through the library once per worker, its ids are
kept in a bounded table and a text's ids are put together from there. A rank file lists no merges: every split of a
token into two tokens is one, in the order of the tokens' ranks.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import P, table

#: Entries of a worker's table of known matches, and characters of one: longer matches are not kept. A full table starts anew.
KNOWN, KEPT = 250_000, 48


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The library's tokenizer for one rank file and pattern, and the table that reverses it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        spell = lambda token: "".join(chars[b] for b in token)
        ordered = sorted(ranks, key=ranks.__getitem__)
        merges = [(spell(t[:k]), spell(t[k:])) for t in ordered for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={spell(t): ranks[t] for t in ordered}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = regex.compile(pattern).findall
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of = np.full(max(ranks.values()) + 1, None, dtype=object)
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        found = self.matches(text)
        if new := list(set(found).difference(self.known)):
            if len(self.known) + len(new) > KNOWN:
                self.known = {}
                new = list(set(found))
            long = {}
            for piece, coded in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
                (self.known if len(piece) <= KEPT else long)[piece] = np.array(coded.ids, dtype=np.int32).tobytes()
            if long:
                return np.frombuffer(b"".join(long[m] if m in long else self.known[m] for m in found), dtype=np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, found)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())


@functools.lru_cache(maxsize=2)
def _codec(ranks: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec({t: i for i, t in enumerate(ranks) if t}, pattern)


def _shared(spark: SparkSession, path: str):
    """The rank table, read on the driver and sent to each executor once; its size is the vocabulary's."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return spark.sparkContext.broadcast(tuple(table))


def _offsets(text: str, ids, bytes_of) -> list[list[int]]:
    """For each id, the first character it touches and the one after the last; ids that split a character share it."""
    if not len(ids):
        return []
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum([len(bytes_of[i]) for i in ids])
    starts = np.concatenate([[0], ends[:-1]])
    return np.stack([char_of[starts], char_of[ends - 1] + 1], axis=1).tolist()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def encode(text: Column | str, ranks, pattern: str) -> Column:
    """array<int> of the text's ids, without special tokens. Null or empty: no ids."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            yield _lists([codec.ids(t.as_py() or "") for t in batch])

    return run(text)


def decode(ids: Column | str, ranks, pattern: str) -> Column:
    """The bytes that the ids stand for; null or no ids give none. An id outside the vocabulary is an error.

    Bytes are joined before anything reads them as characters, so a character split over ids comes out whole."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            at, values = batch.offsets.to_numpy(), batch.values.to_numpy()
            yield pa.array([codec.decode(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())

    return run(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<int>")))


def round_trip(text: Column | str, ranks, pattern: str, with_offsets: bool = False) -> Column:
    """struct<ids, decoded, offsets>: encode and decode in one crossing to Python. decoded comes from the ids alone.

    offsets: [start, end) in characters for each id, null unless asked for."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary,offsets:array<array<int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks.value, pattern)
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            texts = batch if with_offsets else ()
            coded = [codec.ids(t.as_py() or "") for t in batch]
            places = pa.array(
                [_offsets(t.as_py() or "", i, codec.bytes_of) for t, i in zip(texts, coded, strict=False)], kind,
            ) if with_offsets else pa.nulls(len(batch), kind)
            yield pa.StructArray.from_arrays(
                [_lists(coded), pa.array([codec.decode(i) for i in coded], pa.binary()), places],
                names=["ids", "decoded", "offsets"],
            )

    return run(text)


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """docs with ids (array<int>), decoded (binary) and, if asked for, offsets (array of [start, end) characters).

    Columns of docs with those names are replaced. Rows are handled one by one: repeated rows, nulls in other columns
    and empty tables need no rule; a null text has no ids and decodes to no bytes."""
    ranks = _shared(docs.sparkSession, ranks_path)
    new = ["ids", "decoded", "offsets"] if with_offsets else ["ids", "decoded"]
    rest = [c for c in docs.columns if c.lower() not in new]
    coded = docs.select(*[F.col(f"`{c}`") for c in rest], round_trip(F.col(f"`{text_col}`"), ranks, pattern, with_offsets).alias(P + "coded"))
    return coded.select(*[F.col(f"`{c}`") for c in rest], *[F.col(P + "coded")[c].alias(c) for c in new])


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = byte_bpe(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
