"""Hashes and seeded vectors on whole NumPy arrays, and the Arrow UDFs that use them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hvspark.functions.vectors import active

GROUPS = 64
_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
CHARS, WORDS, PHRASES, ATOMS = 1, 2, 3, 0xFD  #: levels of seeds


def mixed(a, b) -> np.ndarray:
    """A 64-bit hash of two numbers, element by element, with wrap-around."""
    with np.errstate(over="ignore"):
        z = np.asarray(a, _U) * _GOLD + np.asarray(b, _U)
        z = (z ^ (z >> _U(30))) * _M1
        z = (z ^ (z >> _U(27))) * _M2
        return z ^ (z >> _U(31))


def text_seed(text: str, level: int) -> int:
    """The bytes folded one after the other into the level's number."""
    h = level
    mask = (1 << 64) - 1
    for b in text.encode():
        z = (h * 0x9E3779B97F4A7C15 + b) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        h = z ^ (z >> 31)
    return h


def seeded(seeds: np.ndarray, dim: int, rate: int | None = None) -> np.ndarray:
    """A row of active indices for each seed: hashed places, and more of them until enough are distinct.

    With a rate the places come without groups.
    """
    seeds = np.asarray(seeds, _U)
    k = active(dim) if rate is None else max(dim // max(rate, 1), 1)
    each = 0 if rate is not None else k // GROUPS
    if each:
        group = mixed(seeds[:, None], np.arange(GROUPS, dtype=_U)[None, :])
        first = mixed(group[:, :, None], np.arange(each, dtype=_U)[None, None, :]).reshape(len(seeds), -1)
    else:
        first = mixed(seeds[:, None], np.arange(k, dtype=_U)[None, :])
    out = np.sort((first % _U(dim)).astype(np.int64), 1)
    short = out.shape[1] < k
    dup = np.flatnonzero((np.diff(out, axis=1) == 0).any(1)) if not short else np.arange(len(out))
    if short:
        out = np.concatenate([out, np.zeros((len(out), k - out.shape[1]), np.int64)], 1)
        out_first = first.shape[1]
    else:
        out_first = k
    for r in dup.tolist():
        have = set(out[r, :out_first].tolist())
        with np.errstate(over="ignore"):
            more = mixed(seeds[r] + _U(0xDEAD), np.arange(k * 10, dtype=_U)) % _U(dim)
        for x in more.tolist():
            if len(have) >= k:
                break
            have.add(int(x))
        row = sorted(have)
        out[r] = row + [-1] * (k - len(row))
    return out


def rows_of(matrix: np.ndarray) -> list[list[int]]:
    return [r[r >= 0].tolist() for r in matrix]


def seeded_udf(dim: int, rate: int | None = None):
    """array<int> for each bigint seed (its 64 bits unsigned)."""

    @F.pandas_udf("array<int>")
    def run(seed: pd.Series) -> pd.Series:
        return pd.Series(rows_of(seeded(seed.to_numpy(np.int64).view(_U), dim, rate)))

    return run


def atom_udf(dim: int):
    """The vector of a name."""

    @F.pandas_udf("array<int>")
    def run(name: pd.Series) -> pd.Series:
        names, of = np.unique(name.fillna("").to_numpy(str), return_inverse=True)
        rows = rows_of(seeded(np.array([text_seed(x, ATOMS) for x in names], _U), dim))
        return pd.Series([None if n is None else rows[i] for n, i in zip(name, of)])

    return run


def _majority(counts: dict[int, int] | np.ndarray, n: int, k: int) -> np.ndarray:
    """Indices in half of n vectors at least, the k most frequent of them, the lesser first among equals."""
    keep = np.flatnonzero(counts >= (n + 1) // 2)
    if len(keep) > k:
        keep = np.sort(keep[np.lexsort((keep, -counts[keep]))[:k]])
    return keep


class TextEncoder:
    """Text to vector: character n-grams, words by position and word pairs, each level bundled, then together."""

    def __init__(self, dim: int, sizes: tuple[int, ...] = (2, 3, 4, 5)):
        self.dim, self.sizes, self.k = dim, sizes, active(dim)
        self.memo: dict[int, np.ndarray] = {}

    def _vector(self, seed: int) -> np.ndarray:
        if seed not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            row = seeded(np.array([seed], _U), self.dim)[0]
            self.memo[seed] = row[row >= 0]
        return self.memo[seed]

    def _bundle(self, parts: list[np.ndarray]) -> np.ndarray:
        counts = np.bincount(np.concatenate(parts), minlength=self.dim) if parts else np.zeros(self.dim, np.int64)
        return _majority(counts, len(parts), self.k)

    def _bound(self, vectors: list[np.ndarray], shift: int = 0) -> np.ndarray:
        """Each vector moved by its place, bound; all moved by shift."""
        flat = np.concatenate([(v + i) % self.dim for i, v in enumerate(vectors)])
        index, n = np.unique(flat, return_counts=True)
        return (index[n % 2 == 1] + shift) % self.dim

    def encode(self, text: str | None) -> list[int] | None:
        if text is None:
            return None
        text = text.strip()
        if not text:
            return []
        levels = []
        for n in self.sizes:
            if len(text) >= n:
                scale = int(mixed(CHARS, n))
                seeds = [int(mixed(scale, ord(c))) for c in text]
                grams: dict[tuple, np.ndarray] = {}
                parts = []
                for i in range(len(text) - n + 1):
                    gram = tuple(seeds[i : i + n])
                    if gram not in grams:
                        grams[gram] = self._bound([self._vector(s) for s in gram])
                    parts.append(grams[gram])
                levels.append(self._bundle(parts))
        words = re.split(r"\s+", text)
        levels.append(self._bundle([(self._vector(text_seed(w, WORDS)) + i) % self.dim for i, w in enumerate(words)]))
        if len(words) > 1:
            pairs = [self._bound([self._vector(text_seed(a, PHRASES)), self._vector(text_seed(b, PHRASES))], i) for i, (a, b) in enumerate(zip(words, words[1:]))]
            levels.append(self._bundle(pairs))
        counts = np.bincount(np.concatenate(levels), minlength=self.dim) if levels else np.zeros(self.dim, np.int64)
        keep = np.flatnonzero(counts)
        if len(keep) > self.k:
            keep = np.sort(keep[np.lexsort((keep, -counts[keep]))[: self.k]])
        return keep.tolist()


_encoders: dict[int, tuple[TextEncoder, dict[str, list[int]]]] = {}
TEXTS, CHARS_KEPT = 20_000, 200  #: texts, and characters of each, that a worker remembers with their vectors


def encoded(texts: pd.Series, dim: int) -> list[list[int] | None]:
    """The vectors of texts; an encoder stays in its worker, and short texts that come again are encoded once."""
    encoder, known = _encoders.setdefault(dim, (TextEncoder(dim), {}))
    out = []
    for x in texts:
        if x is None or x != x:
            out.append(None)
            continue
        hv = known.get(x)
        if hv is None:
            hv = encoder.encode(x)
            if len(x) <= CHARS_KEPT:
                if len(known) >= TEXTS:
                    known.clear()
                known[x] = hv
        out.append(hv)
    return out


def text_udf(dim: int):
    @F.pandas_udf("array<int>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(encoded(text, dim))

    return run

    return run


_signs: dict[tuple[int, int], np.ndarray] = {}


def signs(dim: int, width: int) -> np.ndarray:
    """The sparse ternary projection: +1, -1 and 0 with chances of 1/6, 1/6 and 2/3, by a hash of the place."""
    if (dim, width) not in _signs:
        r = mixed(np.arange(dim, dtype=_U)[:, None], np.arange(width, dtype=_U)[None, :]) % _U(6)
        _signs[dim, width] = (r == 0).astype(np.float64) - (r == 5)
    return _signs[dim, width]


def dense_rows(x: np.ndarray, dim: int) -> np.ndarray:
    """Indices of the projections that are largest by amount, the lesser first among equals."""
    k = active(dim)
    amount = np.abs(x.astype(np.float64) @ signs(dim, x.shape[1]).T)
    edge = np.partition(amount, dim - k, 1)[:, dim - k]
    out = np.empty((len(x), k), np.int64)
    for r in range(len(x)):
        at = np.flatnonzero(amount[r] >= edge[r])
        out[r] = np.sort(at[np.lexsort((at, -amount[r, at]))[:k]])
    return out


def dense_udf(dim: int):
    """array<int> for each array<float>; empty for an empty one."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [] if not len(x) else dense_rows(np.asarray(x, np.float32)[None, :], dim)[0].tolist() for x in v])

    return run


def hash_permute_udf(dim: int):
    """Indices scrambled by a hash with a seed."""

    @F.pandas_udf("array<int>")
    def run(hv: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.unique((mixed(np.asarray(x, np.int64).astype(_U), _U(s)) % _U(dim)).astype(np.int64)).tolist() for x, s in zip(hv, seed)])

    return run


def autoencode_udf(weights: np.ndarray, bias: np.ndarray, k: int):
    """Indices of the k greatest positive activations of ``x @ weights + bias``."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            h = np.maximum(np.asarray(x, np.float64) @ weights + bias, 0)
            top = np.lexsort((np.arange(len(h)), -h))[:k]
            out.append(np.sort(top[h[top] > 0]).tolist())
        return pd.Series(out)

    return run


def fractional(base: Column, x: Column, phases: int) -> Column:
    """A number as powers of base phases."""
    return F.transform(base, lambda b: F.pmod(b * x, F.lit(phases)).cast("int"))
