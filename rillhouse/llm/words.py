"""Vectorised words: positions and 64-bit hashes of the words of many texts at once, on raw UTF-8 bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
#: Fixed odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240614)).integers(0, 1 << 64, 256, dtype=np.uint64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: white space \x20 \x09-\x0D; or everything in ASCII that is no letter and no digit.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
#: Bytes of text that are hashed together; a longer text makes one larger piece.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW[0][:n], _POW[1][:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    pw, inv = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * pw[: len(buf)], out=acc[1:])
    return mix((acc[end] - acc[start]) * inv[start])


class Words:
    """Words of some texts: start and end byte, hash, and for text i the words first[i] to first[i + 1]."""

    __slots__ = ("buf", "end", "first", "h", "start")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACES, lower: bool = False):
        n = len(buf)
        self.buf = buf = LOWER[buf] if lower else buf
        gap = between[buf]
        starts, ends = ~gap, ~gap
        if n:
            edge = np.zeros(n + 1, bool)
            edge[offs] = True
            starts[1:] &= gap[:-1] | edge[1:n]
            ends[:-1] &= gap[1:] | edge[1:n]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.h = span_hashes(buf, self.start, self.end)
        self.first = np.searchsorted(self.start, offs)


def pieces(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about PIECE bytes; every text stays whole."""
    buf, offs = utf8(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def shingles(w: Words, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; fewer words, but not none, are one shingle."""
    h, out = w.h, []
    acc = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        acc = mix(acc * _U(_BASE) + h[j : j + len(acc)])
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(acc[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            x = np.array([b - a], np.uint64)
            for v in h[a:b]:
                x = mix(x * _U(_INV) + v)
            out.append(x)
        else:
            out.append(acc[:0])
    return out


#: Rows and bytes of an Arrow batch, the same for every operator, so that the memory of a worker does not grow with
#: the length of texts; one text longer than that makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session of df."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


_KEPT: dict = {}


def kept(key, make):
    """One object per worker process, made at its first use; whatever another operator kept is dropped for it."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what an earlier operator kept in this worker, and give its memory back."""
    _KEPT.clear()
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(f):
    """A map over batches whose worker keeps nothing of earlier operators, nor of its own batches when it ends.

    Workers wait for other tasks with all the memory that they have: four of them beside one executor's heap.
    """

    def run(batches):
        release()
        yield from f(batches)
        trim()

    return run


def keeping(f):
    """As tidy, for a map that uses kept()."""

    def run(batches):
        yield from f(batches)
        trim()

    return run
