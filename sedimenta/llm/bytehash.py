"""Hashes of bytes, words and word sequences over whole Arrow columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes that separate words: space and the controls from tab to carriage return.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U(BASE))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span, from sums over prefixes.

    With `wide`, the symbols are the mixed 8-byte words that begin at each byte, so that no arithmetic relation between single bytes (as in
    Thue-Morse words, which have equal polynomial hashes modulo 2**64 in any base) carries over; spans then have 8 bytes at least.
    """

    _power = _inverse = np.ones(1, np.uint64)

    @classmethod
    def tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._power) <= n:
            size = max(n + 1, 1 << 20)
            for name, base in (("_power", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                setattr(cls, name, np.cumprod(t, dtype=np.uint64))
        return cls._power, cls._inverse

    def __init__(self, data: np.ndarray, wide: bool = False) -> None:
        power, self.inverse = self.tables(len(data))
        self.sums, self.short = np.zeros(len(data) + 1, np.uint64), 7 * wide
        if wide:
            symbol = np.zeros(len(data), np.uint64)
            padded = np.concatenate((data, np.zeros(7, np.uint8)))
            for k in range(8):
                symbol |= padded[k : k + len(data)].astype(np.uint64) << U(8 * k)
            symbol = mix64(symbol + U(BASE))
        else:
            symbol = BYTE[data]
        np.cumsum(symbol * power[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end; the length isn't part of it."""
        return (self.sums[end - self.short] - self.sums[start]) * self.inverse[start]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each word's row; words end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64(Rolling(data).span(starts, ends) + (ends - starts).astype(np.uint64))


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Of each n words in sequence, whatever row they are in."""
    out = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        out = (out * U(BASE)) + word[k : k + len(out)]
    return mix64(out)
