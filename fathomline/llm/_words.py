"""Words and word shingles of many texts at once, as 64-bit hashes, with numpy over their bytes.

A word's hash is a polynomial in its bytes modulo 2**64 with an odd base, taken from prefix sums, then mixed."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
#: Bytes of words: all but ASCII white space, or ASCII letters, digits and whatever is beyond ASCII.
NOT_SPACE = ~np.isin(_BYTE, [9, 10, 11, 12, 13, 32, 0])
LETTERS = ((_BYTE >= 48) & (_BYTE <= 57)) | _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look independent (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """raw: the texts' bytes as they came, a newline after each; start, end: each word's place there; doc: its text's number; hash: of the lower-cased word."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def words(texts: list[str], kind: np.ndarray = NOT_SPACE) -> Words:
    """The words of the texts. A text that takes another number of bytes in lower case is read in lower case throughout."""
    low = [t.encode("utf-8", "replace") if t.isascii() else t.lower().encode("utf-8", "replace") for t in texts]
    parts = [x if t.isascii() or len(as_is := t.encode("utf-8", "replace")) != len(x) else as_is for t, x in zip(texts, low, strict=True)]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    lower = LOWER[np.frombuffer(b"\n".join(low) + b"\n", dtype=np.uint8)]
    inside = kind[raw].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << int(len(raw)).bit_length())
    with np.errstate(over="ignore"):
        sums = np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
        before = np.where(start > 0, sums[start - 1], np.uint64(0))
        hashed = mix((sums[end - 1] - before) * down[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
    return Words(raw, start, end, np.searchsorted(first, start, side="right") - 1, hashed)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (number of its first word) of each run of `size` words that lies within one text."""
    return windows(w.hash, w.doc, size)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * _BASE + hashes[k : k + n]
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        return mix(total[at]), at


def slices(texts: pa.Array | list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """The texts (null: empty) in runs of about `size` characters, each with the number of its first text; only a run is held at a time."""
    first, run, total = 0, [], 0
    for k, t in enumerate(texts):
        run.append((t.as_py() if isinstance(t, pa.Scalar) else t) or "")
        total += len(run[-1])
        if total >= size:
            yield first, run
            first, run, total = k + 1, [], 0
    if run:
        yield first, run
