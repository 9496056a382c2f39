"""A cuckoo filter over 64-bit hashes: four 16-bit fingerprints a bucket, with removals."""

from __future__ import annotations

import numpy as np

from hvspark.llm.tokens import mix

SLOTS = 4
LOAD = 0.85
KICKS = 500


class Full(Exception):
    """There is no room left; the filter is to be built anew, larger, from the exact hashes."""


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of_size(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / SLOTS / LOAD))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of the distinct hashes, with room for half as many again."""
        n = len(hashes) * 3 // 2
        while True:
            try:
                out = cls.of_size(n)
                out.insert(hashes)
                return out
            except Full:
                n = 2 * n + 8

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(hashes.astype(np.uint64))
        mark = np.maximum(h >> np.uint64(48), np.uint64(1))
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark.astype(np.uint16), first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """No false negatives; false positives at a rate of about 2 * SLOTS / 65536."""
        mark, a, b = self._places(hashes)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(1)

    def insert(self, hashes: np.ndarray) -> None:
        """hashes: distinct, none of them in the filter."""
        mark, a, b = self._places(hashes)
        left = np.arange(len(mark))
        for bucket in (a, b):  # whole arrays at a time, a newcomer to each bucket in a round
            for slot in range(SLOTS):
                if not len(left):
                    return
                free = left[self.table[bucket[left], slot] == 0]
                into, pick = np.unique(bucket[free], return_index=True)
                self.table[into, slot] = mark[free[pick]]
                left = np.setdiff1d(left, free[pick], assume_unique=True)
        rng = np.random.default_rng(1)
        for i in left.tolist():
            self._kick(int(a[i]), int(mark[i]), rng)

    def _kick(self, bucket: int, mark: int, rng: np.random.Generator) -> None:
        for _ in range(KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
            slot = int(rng.integers(SLOTS))
            row[slot], mark = mark, int(row[slot])
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint64))[0])
        raise Full

    def remove(self, hashes: np.ndarray) -> None:
        """hashes: distinct, all of them in the filter."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(hashes))):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
