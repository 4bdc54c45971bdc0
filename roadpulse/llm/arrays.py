"""Numpy helpers for tasks: texts of an Arrow column as one byte array, word and window hashes.

All functions work on chunks of about ``CHUNK`` bytes, so the memory of a task
follows its longest text, not its partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
CHUNK_DOCS = 256            # document index fits 8 bits beside a 56-bit hash

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.ones(256, bool)          # everything but ASCII letters, digits and bytes of longer characters
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if _powers.get("n", 0) < n:
        m = max(n, CHUNK + (CHUNK >> 2))
        for name, b in (("up", BASE), ("down", INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
        _powers["n"] = m
    return _powers["up"][:n], _powers["down"][:n]


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def long_column(table: pa.Table, name: str, null: int) -> np.ndarray:
    return np.asarray(column(table, name).cast(pa.int64()).fill_null(null))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def chunks(offsets: np.ndarray, size: int = CHUNK, most: int = CHUNK_DOCS):
    """(first, last+1) runs of documents of about ``size`` bytes, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n, i + most)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
    """Words of the documents ``data[offs[i]:offs[i+1]]`` (offs[0] == 0).

    Returns (hash, start, end, first): ``first`` holds the index of each
    document's first word, with the total at its end.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    inside = ~space[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < n]
    head[at] = inside[at]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    at = at[at > 0] - 1
    tail[at] = inside[at]
    s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = powers(n)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE[data] * up, out=c[1:])
    h = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, offs)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (documents not regarded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j:j + n] * np.uint64(pow(int(STEP), j, 1 << 64))
    return mix(out)


def whole(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n runs of k words lie in one document."""
    ok = np.ones(max(n, 0), bool)
    for j in range(1, k):   # the run starting j words before a document's end is cut
        at = first[1:] - j
        at = at[(at >= 0) & (at < n) & (at >= first[:-1])]
        ok[at] = False
    return ok


def group_min(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the least value of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.minimum.reduceat(values[order], at)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the ascending array ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    return known[np.minimum(at, len(known) - 1)] == keys
