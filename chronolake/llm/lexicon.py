"""A lexicon of spans of text: each distinct span is tokenized once for a worker, all others are looked up.

Spans are known by a 64-bit hash of their bytes and their length; a worker keeps MOST_SPANS of them and
then starts anew, so memory is bounded and a collision has a chance of about 1e-7 for a full lexicon.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import regions as R

MOST_SPANS = 2_000_000


class Lexicon:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each span in begin and count."""
        if not len(starts):
            return np.zeros(0, np.int64)
        lo, hi = int(starts[0]), int(ends[-1])
        hashes = R.span_hashes(R._BYTE_HASH[data[lo:hi]], starts - lo, ends - lo, R._BASE_W)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > MOST_SPANS:
            self._reset()
        at = np.searchsorted(self.hashes, unique)
        new = np.append(self.hashes, [np.uint64(0)])[at] != unique if len(self.hashes) else np.ones(len(unique), bool)
        new |= at == len(self.hashes)
        if new.any():
            raw = data[lo:hi].tobytes()
            ids = self.encode([raw[a:b] for a, b in zip((starts[first[new]] - lo).tolist(), (ends[first[new]] - lo).tolist())])
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.uint32, int(count.sum()))
            slot = np.arange(len(self.begin), len(self.begin) + len(ids))
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.flat = np.append(self.flat, flat)
            self.hashes, self.slot = np.insert(self.hashes, at[new], unique[new]), np.insert(self.slot, at[new], slot)
            at = np.searchsorted(self.hashes, unique)
        return self.slot[at][inverse]

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of spans, one after another."""
        count = self.count[slots]
        out = np.cumsum(count) - count
        return self.flat[np.repeat(self.begin[slots] - out, count) + np.arange(int(count.sum()))]
