"""Suffix sorting by external induction, with common-prefix values carried along.

``induced_suffix_array`` sorts every suffix of a text by the induction of S* suffixes:

1.  S* suffixes are bucketed by their first symbol and induced once, which sorts the S* substrings.
2.  The substrings get names; if names repeat, the string of names is sorted by the same procedure,
    recursively, until it is small enough to be ranked in memory.
3.  The sorted S* suffixes are induced a second time, first the L suffixes by an ascending scan,
    then the S suffixes by a descending one.  Each tuple in flight is (suffix, common prefix with its
    neighbour); the common prefix of two induced neighbours is one more than the minimum over the
    scanned range between their sources, so the values never need the text again.

Tuples in flight are held by ``TupleQueue``, a priority queue over symbols with whole arrays as
payload.  When the tuples outgrow the memory bound, the runs whose symbols are popped last are written
to an unnamed scratch file of the task and read back when their turn comes.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

#: Common-prefix values are kept in a byte and saturate here.
LCP_CAP = 250
#: Bytes of UTF-8 that never occur: one stands for NUL, one separates strings. 0 ends the text.
NUL_BYTE, SEPARATOR = 0xF8, 0xFF


class TupleQueue:
    """Priority queue of (symbol, suffix, common prefix) tuples, first in first out within a symbol."""

    def __init__(self, memory_bytes: int, descending: bool = False):
        self.memory, self.sign = memory_bytes, -1 if descending else 1
        self.runs: dict[int, list] = {}
        self.heap: list[int] = []
        self.held = self.spilled = 0
        self.file = None

    def push(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        if symbol not in self.runs:
            self.runs[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        self.runs[symbol].append((suffixes, common))
        self.held += suffixes.nbytes + common.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol in sorted(self.runs, reverse=self.sign > 0):  # the last to be popped go first
            kept = []
            for run in self.runs[symbol]:
                if isinstance(run[0], np.ndarray) and self.held > self.memory // 2:
                    kept.append((self.file.tell(), len(run[0]), run[0].dtype))
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    self.held -= run[0].nbytes + run[1].nbytes
                    self.spilled += 1
                else:
                    kept.append(run)
            self.runs[symbol] = kept
            if self.held <= self.memory // 2:
                return

    def first(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of a symbol that is at the front (or absent)."""
        if symbol not in self.runs:
            return None
        heapq.heappop(self.heap)
        parts = []
        for run in self.runs.pop(symbol):
            if isinstance(run[0], np.ndarray):
                self.held -= run[0].nbytes + run[1].nbytes
                parts.append(run)
            else:
                at, n, kind = run
                self.file.seek(at)
                a = np.frombuffer(self.file.read(n * kind.itemsize), kind)
                parts.append((a, np.frombuffer(self.file.read(n), np.uint8)))
        return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] (inclusive, lo <= hi) for many ranges, by a table of powers of two."""
    table = [values]
    width = int((hi - lo + 1).max()) if len(lo) else 1
    while 2 << (len(table) - 1) <= width:
        step, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-step], last[step:]))
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k)) + 1])
    return out


class _Scan:
    """One induction scan: takes scanned runs in order and emits their predecessors to a queue."""

    def __init__(self, text, wanted, queue, with_common, sigma):
        self.text, self.wanted, self.queue, self.common = text, wanted, queue, with_common
        self.seen, self.low = np.zeros(sigma, bool), np.full(sigma, LCP_CAP, np.uint8)

    def feed(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """common[i]: with the suffix scanned just before (0 at the start of a bucket)."""
        before = suffixes - 1
        at = np.flatnonzero(before >= 0)
        at = at[self.wanted[before[at]]]
        symbols = self.text[before[at]]
        if not len(at):
            if self.common:
                np.minimum(self.low, common.min(), out=self.low)
            return
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        heads = np.flatnonzero(np.diff(symbols, prepend=-1))
        keys, ends = symbols[heads].astype(np.int64), np.append(heads[1:], len(at))
        values = np.zeros(len(at), np.uint8)
        if self.common:
            inner = np.ones(len(at), bool)
            inner[heads] = False
            inner = np.flatnonzero(inner)
            values[inner] = _range_minima(common, at[inner - 1] + 1, at[inner])
            prefix = np.minimum.accumulate(common)
            values[heads] = np.minimum(prefix[at[heads]], self.low[keys])
            values = np.minimum(values, LCP_CAP - 1) + np.uint8(1)
            values[heads[~self.seen[keys]]] = 0
            np.minimum(self.low, prefix[-1], out=self.low)
            suffix = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(LCP_CAP))
            self.low[keys] = suffix[at[ends - 1] + 1]
            self.seen[keys] = True
        moved = before[at]
        for k, a, b in zip(keys.tolist(), heads.tolist(), ends.tolist()):
            self.queue.push(k, moved[a:b], values[a:b])


class _Prefixes:
    """Common prefixes of pairs of suffixes of a byte text, by words of eight bytes."""

    def __init__(self, text: np.ndarray):
        raw = text.tobytes() + b"\0" * (LCP_CAP + 16)
        self.words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        self.n = len(text)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), LCP_CAP, np.int64)
        live = np.arange(len(a))
        for k in range(0, LCP_CAP + 8, 8):
            x = self.words[np.minimum(a[live] + k, self.n)] ^ self.words[np.minimum(b[live] + k, self.n)]
            differ = x != 0
            y = x[differ]
            first = np.frexp((y & (~y + np.uint64(1))).astype(np.float64))[1] - 1
            out[live[differ]] = k + first // 8
            live = live[~differ]
            if not len(live):
                break
        return np.minimum(out, LCP_CAP).astype(np.uint8)


def _rank_in_memory(names: np.ndarray) -> np.ndarray:
    """Suffix array of a short string of names by doubling of ranks."""
    n = len(names)
    rank, k = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] if k < n else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        if new[order[-1]] == n or k >= n:
            return order
        rank, k = new, 2 * k


def _names(text: np.ndarray, sorted_stars: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names (from 1) of S* substrings in sorted order; equal substrings share one."""
    a, b = sorted_stars[:-1], sorted_stars[1:]
    same = length[:-1] == length[1:]
    live, k = np.flatnonzero(same), 0
    while len(live):
        if len(live) <= 16 and k > 64:
            for i in live.tolist():
                same[i] = np.array_equal(text[a[i] : a[i] + length[i]], text[b[i] : b[i] + length[i]])
            break
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (length[live] > k)]
    return np.append(0, np.cumsum(~same)) + 1


def induced_suffix_array(text: np.ndarray, memory_bytes: int = 1 << 28, with_common: bool = True, in_memory: int = 1 << 21, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array of ``text`` (non-negative integers that end with their only 0) and, for byte texts,
    each suffix's common prefix with the one before it (saturating at LCP_CAP).

    memory_bytes bounds the tuples in flight; longer strings of names than in_memory are sorted by
    recursion.  An empty text gives empty arrays.
    """
    n = len(text)
    kind = np.int32 if n < 2**31 - 1 else np.int64
    if n <= 1:
        return np.arange(n, dtype=kind), np.zeros(n, np.uint8) if with_common else None
    sigma = int(text.max()) + 1
    up = np.sign(np.diff(text.astype(np.int64)))
    turn = np.flatnonzero(up)
    is_s = np.append(up[turn[np.minimum(np.searchsorted(turn, np.arange(n - 1)), len(turn) - 1)]] > 0, True)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(kind) + kind(1)
    is_l = ~is_s

    def induce(seeds: np.ndarray, seed_common: np.ndarray, common: bool) -> tuple[list, np.ndarray, np.ndarray | None]:
        """seeds: S* suffixes in their order within each symbol. Returns all suffixes in induced order."""
        queue, out = TupleQueue(memory_bytes), {}
        up_scan = _Scan(text, is_l, queue, common, sigma)
        symbols = text[seeds]
        heads = np.flatnonzero(np.diff(symbols.astype(np.int64), prepend=-1))
        bucket = {int(symbols[a]): (a, b) for a, b in zip(heads.tolist(), np.append(heads[1:], len(seeds)).tolist())}
        todo = sorted(bucket, reverse=True)
        while todo or queue.heap:
            c = min(x for x in (todo[-1] if todo else None, queue.first()) if x is not None)
            while (run := queue.pop(c)) is not None:
                out.setdefault(c, []).append(run)
                up_scan.feed(*run)
            if todo and todo[-1] == c:
                todo.pop()
                a, b = bucket[c]
                own = seed_common[a:b].copy()
                own[0] = seam(out[c][-1][0][-1], seeds[a]) if common and c in out else 0
                up_scan.feed(seeds[a:b], own)
        spilled = queue.spilled
        queue = TupleQueue(memory_bytes, descending=True)
        down, order, values = _Scan(text, is_s, queue, common, sigma), [], []
        todo = sorted(out)
        while todo or queue.heap:
            c = max(x for x in (todo[-1] if todo else None, queue.first()) if x is not None)
            runs = []
            while (run := queue.pop(c)) is not None:
                runs.append(run)
                down.feed(*run)
            smalls = [np.concatenate(x) for x in zip(*runs)] if runs else None
            if smalls is not None:
                order.append(smalls[0])
                values.append(np.append(smalls[1][1:], np.uint8(0)))
            if todo and todo[-1] == c:
                todo.pop()
                larges = [np.concatenate(x) for x in zip(*out.pop(c))]
                shifted = np.append(larges[1][1:], np.uint8(0))
                if smalls is not None and common:
                    shifted[-1] = values[-1][-1] = seam(larges[0][-1], smalls[0][-1])
                down.feed(larges[0][::-1], shifted[::-1])
                order.append(larges[0][::-1])
                values.append(np.append(larges[1][:0:-1], np.uint8(0)))
        if stats is not None:
            stats["spilled"] = stats.get("spilled", 0) + spilled + queue.spilled
        order = np.concatenate([*order, np.array([n - 1], kind)])[::-1]
        return order, np.append(np.zeros(1, np.uint8), np.concatenate(values)[::-1]) if common else None

    prefixes = _Prefixes(text) if with_common else None

    def seam(a, b) -> int:
        return prefixes.of(np.array([a]), np.array([b]))[0]

    none = np.zeros(len(star), np.uint8)
    first = star[np.argsort(text[star], kind="stable")]
    order, _ = induce(first, none, False)
    is_star = np.zeros(n, bool)
    is_star[star] = True
    stars = order[is_star[order]]
    index = np.empty(n, kind)
    index[star] = np.arange(len(star), dtype=kind)
    length = np.append(np.diff(star) + 1, 1).astype(np.int64)
    names = _names(text, stars, length[index[stars]])
    if names[-1] < len(stars):
        reduced = np.empty(len(stars), np.int64)
        reduced[index[stars]] = names
        if len(reduced) <= in_memory:
            inner = _rank_in_memory(reduced)
        else:
            if stats is not None:
                stats["recursions"] = stats.get("recursions", 0) + 1
            # The name of the text's end is 1 and occurs once; as 0 it ends the reduced string.
            inner, _ = induced_suffix_array(reduced - 1, memory_bytes, False, in_memory, stats)
        stars = star[inner]
    common = np.append(np.uint8(0), prefixes.of(stars[:-1], stars[1:])) if with_common else none
    return induce(stars, common, with_common)


def join_strings(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text over all strings, with separators and the end; and where each string starts."""
    raw = np.frombuffer(b"\xff".join(strings) + b"\xff\0", np.uint8).copy()
    body = raw[:-1]
    body[body == 0] = NUL_BYTE
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return raw, np.cumsum(lengths + 1) - (lengths + 1)


def window_classes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, memory_bytes: int = 1 << 28) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of join_strings, all places of windows of ``width`` bytes in suffix order, and the
    number of each one's class of equal windows. A width above LCP_CAP raises ValueError."""
    if width > LCP_CAP:
        raise ValueError(f"windows may have {LCP_CAP} bytes at most")
    order, common = induced_suffix_array(text, memory_bytes)
    room = np.zeros(len(text), bool)
    long = lengths >= width
    edges = np.zeros(len(text) + 1, np.int32)
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, starts[long] + lengths[long] - width + 1, -1)
    room = np.cumsum(edges[:-1]) > 0
    classes = np.cumsum(common < width)
    valid = room[order]
    return order[valid], classes[valid]
