"""Vectorised text primitives used inside Arrow tasks (numpy over UTF-8 buffers).

Nothing here knows Spark. Texts come as one byte buffer plus row offsets, which
is how Arrow stores a string column, so no Python string is built per row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: polynomial hashes run modulo two primes below 2**31: a power of two as the modulus lets patterned texts collide
PRIMES = (2147483647, 2147483629)
#: a base for each prime
BASES = _RNG.integers(1 << 20, PRIMES[1], 2).tolist()
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser; wraps modulo 2**64)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


@lru_cache(maxsize=6)
def _powers_for(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        out[have: 2 * have] = out[:have] * U(pow(base, have, prime))
        if prime < 2**64:
            out[have: 2 * have] %= U(prime)
        have *= 2
    return out


def powers(n: int, base: int, prime: int) -> np.ndarray:
    """base**k modulo prime for k < n; grown in powers of two so that the cache holds."""
    return _powers_for(1 << max(16, int(n - 1).bit_length()), base, prime)


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, by prefix sums modulo two primes."""

    def __init__(self, data: np.ndarray):
        self.parts = []
        value = data.astype(np.uint64) + U(1)
        for base, prime in zip(BASES, PRIMES, strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            term = value * powers(len(data) + 1, base, prime)[: len(data)]
            # terms are below 2**40: sums of up to 2**24 of them fit as they are, of reduced ones up to 2**33
            np.cumsum(term if len(data) <= 1 << 24 else term % U(prime), out=sums[1:])
            self.parts.append((sums, powers(len(data) + 1, pow(base, -1, prime), prime), U(prime)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (((sums[end] - sums[start]) % prime) * down[start] % prime for sums, down, prime in self.parts)
        return mix((a << U(32)) | b)


class WrappingHash:
    """As :class:`RangeHash`, by prefix sums modulo 2**64: a third of the cost, for every position of a
    buffer too. Patterned texts of 1,024 bytes and more can collide, so it never decides alone."""

    def __init__(self, data: np.ndarray):
        self.down = powers(len(data) + 1, _P_INV, 2**64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data) + 1, _P, 2**64)[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def fixed(self, width: int) -> np.ndarray:
        """Hash of every range of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, raw = column.buffers()
    kind = np.int64 if wide else np.int32
    if where is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.empty(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, most: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Sub-batches of at most ``most`` text bytes; a longer row comes alone, whole."""
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of non-space bytes; rows never share a word."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    ok = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], ok[:-1]))
    after = np.concatenate((ok[1:], [False]))
    start = np.flatnonzero(ok & (~before | edge[:-1]))
    end = np.flatnonzero(ok & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each row as offsets)."""
    data = LOWER[data]
    start, end, row = words(data, offsets)
    h = RangeHash(data)(start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    return h, first


def sequence_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words: (hash, position in ``h``, row)."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = mix(out * U(_P) + h[at + j])
    return out, at, row


def row_offsets(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the rows 0..n-1 in a sorted row-index array."""
    return np.searchsorted(row, np.arange(n + 1))
