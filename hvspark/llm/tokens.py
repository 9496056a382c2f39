"""Word tokens and their hashes, taken from Arrow string columns with whole-array NumPy steps.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters; case is
folded for ASCII and for the Latin-1 letters. ``words`` is the plain definition of it, against
which the tests hold the array version. Words are hashed to 64 bits by a polynomial over their
UTF-8 bytes; equality of hashes stands for equality of words (n distinct words collide with
a probability of about n**2 / 2**65).

Nulls count as empty texts. A text of any length is handled whole; columns are cut between
rows into blocks of about ``BLOCK`` bytes so that the arrays stay in the CPU's cache.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_WORD = np.zeros(256, np.bool_)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  #: glibc only
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def words(text: str | None) -> list[str]:
    """The words of a text, by definition (slow)."""
    fold = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(fold))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for successive groups of rows."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@dataclass
class Tokens:
    """Words of a block of rows: row (from 0 in the block), byte range and hash of each."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: n + 1 positions: the words of row r are first[r] .. first[r + 1] - 1


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals made small."""
    low = _LOWER[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3)
        if len(lead):
            c = data[lead + 1]
            low[lead[(c >= 0x80) & (c <= 0x9E) & (c != 0x97)] + 1] += 0x20
    return low


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        none = np.empty(0, np.int64)
        return Tokens(none, none, none, np.empty(0, np.uint64), np.zeros(rows + 1, np.int64))
    inside = _WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    end[tails] = inside[tails]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    value = fold(data).astype(np.uint64)
    value += np.uint64(1)
    value *= up[:n]
    np.cumsum(value, out=sums[1:])
    h = sums[b]
    h -= sums[a]
    h *= down[a]
    first = np.searchsorted(a, offsets)
    return Tokens(np.repeat(np.arange(rows), np.diff(first)), a, b, mix(h), first)


def hash_words(texts: list[str]) -> np.ndarray:
    """The hash of each single word in the list."""
    data, at = utf8(pa.array(texts, pa.large_string()))
    out = np.zeros(len(texts), np.uint64)
    t = tokenize(data[at[0] : at[-1]], at - at[0])
    out[t.row] = t.hash
    return out


def windows(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words, and the position of its first word, in one row each."""
    if len(t.hash) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return window_hashes(t.hash, n), np.flatnonzero(t.row[: len(t.row) - n + 1] == t.row[n - 1 :])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each h[i : i + n], the order of its members counting."""
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= BASE
        out += h[k : k + m]
    return mix(out)
