"""BLAKE3 (256-bit, unkeyed), for all values of an Arrow batch side by side: each step is a numpy operation over all chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the public specification: the initial state, the order of message words after a round, the flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Chunks hashed at once, about.
LANES = 1 << 14


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mixed(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    v[a] = v[a] + v[b] + x
    v[d] = _turned(v[d] ^ v[a], 16)
    v[c] = v[c] + v[d]
    v[b] = _turned(v[b] ^ v[c], 12)
    v[a] = v[a] + v[b] + y
    v[d] = _turned(v[d] ^ v[a], 8)
    v[c] = v[c] + v[d]
    v[b] = _turned(v[b] ^ v[c], 7)


def compress(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8, n) from those before and from blocks (16, n)."""
    n = words.shape[1]
    v = [*value, *(np.full(n, x, np.uint32) for x in IV[:4]), (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length, flags]
    m = list(words)
    for _ in range(7):
        for i in range(4):  # columns, then diagonals
            _mixed(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mixed(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in PERMUTATION]
    return np.array([v[i] ^ v[i + 8] for i in range(8)])


def hashed(values: list[bytes]) -> list[str]:
    """The BLAKE3 hashes of values as lower-case hex."""
    size = np.array([len(x) for x in values], np.int64)
    chunks = np.maximum(1, -(-size // CHUNK))
    owner = np.repeat(np.arange(len(values)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    rest = np.minimum(CHUNK, size[owner] - number * CHUNK)
    data = np.frombuffer(b"".join(x.ljust(k * CHUNK, b"\0") for x, k in zip(values, chunks.tolist(), strict=True)), "<u4").reshape(-1, CHUNK // 4)
    blocks = np.maximum(1, -(-rest // BLOCK))
    value = np.repeat(IV[:, None], len(owner), axis=1)
    alone = chunks[owner] == 1
    for b in range(CHUNK // BLOCK):
        live = np.flatnonzero(blocks > b)
        if not len(live):
            break
        last = blocks[live] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + np.where(last, CHUNK_END, 0) + np.where(last & alone[live], ROOT, 0)
        length = np.minimum(BLOCK, rest[live] - b * BLOCK).astype(np.uint32)
        words = data[live, 16 * b : 16 * b + 16].T.astype(np.uint32)
        value[:, live] = compress(value[:, live], words, number[live].astype(np.uint64), length, flags.astype(np.uint32))
    # neighbours are joined level by level; one that has no neighbour goes up as it is, so left subtrees are the full ones
    while len(owner) > len(values):
        n = np.bincount(owner, minlength=len(values))
        left = np.flatnonzero((number % 2 == 0) & (number + 1 < n[owner]))
        flags = np.where(n[owner[left]] == 2, PARENT + ROOT, PARENT).astype(np.uint32)
        zero = np.zeros(len(left))
        joined = compress(np.repeat(IV[:, None], len(left), axis=1), np.concatenate([value[:, left], value[:, left + 1]]), zero.astype(np.uint64), np.full(len(left), BLOCK, np.uint32), flags)
        value[:, left] = joined
        keep = number % 2 == 0
        value, owner, number = value[:, keep], owner[keep], number[keep] // 2
    return [x.tobytes().hex() for x in np.ascontiguousarray(value.T.astype("<u4"))]


@F.pandas_udf(T.StringType())
def _blake3(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in values:
        known = series.notna().to_numpy()
        raw = [bytes(x) for x in series[known]]
        out: list[str] = []
        at = 0
        while at < len(raw):
            end, lanes = at, 0
            while end < len(raw) and (end == at or lanes < LANES):
                lanes += len(raw[end]) // CHUNK + 1
                end += 1
            out += hashed(raw[at:end])
            at = end
        result = pd.Series([None] * len(series), dtype=object)
        result[known] = out
        yield result


def blake3(value: Column) -> Column:
    """The BLAKE3 of a string's UTF-8 bytes, or of a binary, as lower-case hex; null for null."""
    return _blake3(value.cast("binary"))
