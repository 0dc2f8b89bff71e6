"""Character n-grams of words and byte n-grams of texts, hashed into a fixed table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from kontor.llm import textkit as K

BUCKET_BITS = 18
SIZES = (3, 4, 5)
U = np.uint64
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x500)], np.uint32)
_LOWER[48:58] = 48                       # a digit is a digit
_LETTER = np.array([i >= 128 or chr(i).isalnum() for i in range(0x500)])


class Words:
    """Words of rows of text: lower-cased runs of letters and digits (all of them beyond ASCII).
    All digits count as the same, so that numbers are not remembered one by one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
        at = lead[offsets]
        row = np.repeat(np.arange(rows), np.diff(at))
        small = np.minimum(points, 0x4FF)
        codes = np.where(points < 0x500, _LOWER[small], points)
        codes[~_LETTER[small]] = 0
        # a border (0) before and after every row
        self.codes = np.zeros(len(points) + rows + 6, np.uint64)
        place = np.arange(len(points)) + row + 1
        self.codes[place] = codes
        self.some = self.codes != 0
        start = self.some.copy()
        start[1:] &= ~self.some[:-1]
        self.word = np.cumsum(start) - 1                  # of each place; valid where some
        first = np.flatnonzero(start)
        self.count = len(first)
        self.first = first
        row_at = at + np.arange(rows + 1)                 # place of the border before each row
        self.row = np.searchsorted(row_at, first, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=rows)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, word) of every n-gram, borders included, for each size in turn."""
        c, n = self.codes, len(self.codes)
        h = K.mix(c + U(1))
        inner = np.ones(n, bool)
        for size in range(2, max(SIZES) + 1):
            m = n - size + 1
            h = (h[:m] ^ (c[size - 1:] + U(size))) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(31)
            if size > 2:
                inner = inner[:m] & self.some[size - 2: size - 2 + m]
            if size in SIZES:
                at = np.flatnonzero(inner[:m])
                yield (h[at] >> U(64 - BUCKET_BITS)).astype(np.int64), self.word[at + 1]

    def identity(self) -> np.ndarray:
        """64-bit hash of each word."""
        at = np.flatnonzero(self.some)
        w = self.word[at]
        value = K.mix(self.codes[at] * U(0x9E3779B97F4A7C15) + (at - self.first[w]).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        edges = np.append(np.searchsorted(w, np.arange(self.count)), len(w))
        return K.mix(total[edges[1:]] - total[edges[:-1]])


def byte_grams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every byte n-gram inside a row, as it is written, for each size in turn."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = np.zeros(len(data), np.uint64)
    for size in range(1, max(sizes) + 1):
        m = len(data) - size + 1
        if m <= 0:
            return
        h = (h[:m] ^ (data[size - 1:].astype(np.uint64) + U(size * 256))) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
        if size in sizes:
            same = np.flatnonzero(row[:m] == row[size - 1:])
            yield (K.mix(h[same]) >> U(64 - BUCKET_BITS)).astype(np.int64), row[same]
