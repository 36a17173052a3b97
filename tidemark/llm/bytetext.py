"""Vectorised helpers on UTF-8 text: packing, words and polynomial prefix hashes.

Texts of a batch are joined into one byte buffer, each followed by a line
feed, so that no word and no line spans two documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random odd value for each byte, so that short strings differ in all bits.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
#: space, tab, line feed, vertical tab, form feed, carriage return
SEPARATORS = (32, 9, 10, 11, 12, 13)
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads the low bits' weakness over all."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class PrefixHash:
    """Polynomial hashes of all substrings of a buffer after one linear pass."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUE[buf] * self.power[:n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Packed:
    """Documents joined into one buffer; starts and ends are byte offsets of each."""

    def __init__(self, texts: list[bytes]):
        self.count = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.zeros(len(texts), np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.starts[1:])
        self.ends = self.starts + lengths

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space."""
    return runs(~IS_SEPARATOR[buf])


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` bytes each; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def byte_texts(column) -> list[bytes]:
    """An Arrow binary or string column as bytes, null as empty."""
    return [t if isinstance(t, bytes) else b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def segment_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (one- or two-dimensional) by owner in 0..n-1."""
    if values.ndim == 1:
        return np.bincount(owner, weights=values, minlength=n)
    return np.stack([np.bincount(owner, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def batches(rows: Iterable) -> Iterator:
    """Record batches that have rows."""
    return (b for b in rows if b.num_rows)
