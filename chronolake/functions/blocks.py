"""Matching blocks of two texts: the longest common run, then the same before and after it (Ratcliff and Obershelp)."""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: From this length on, characters of the second text above one in SHARE (and one more) begin no block.
LONG, SHARE = 200, 100


def _automaton(symbols: list) -> tuple[list, list, list, list]:
    """Suffix automaton: transitions, links, longest lengths and first ends of its states; linear in the symbols."""
    go, link, size, first, last = [{}], [-1], [0], [-1], 0
    for at, c in enumerate(symbols):
        new, p = len(go), last
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(at)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] > size[p] + 1:
                part = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = part
                    p = link[p]
                link[q], q = part, part
            link[new] = q
        last = new
    return go, link, size, first


def _longest(a: str, b: str, frequent: set) -> tuple[int, int, int]:
    """Place in a, place in b and length of the longest common run without frequent characters (ties: first in a, then in b)."""
    # A frequent character becomes its own place, which no character of a equals.
    go, link, size, first = _automaton([at if c in frequent else c for at, c in enumerate(b)])
    state = n = 0
    best = (0, 0, 0)
    for at, c in enumerate(a):
        while state and c not in go[state]:
            state = link[state]
            n = size[state]
        state = go[state].get(c, 0)
        n = n + 1 if state else 0
        if n > best[2]:
            best = (at - n + 1, first[state] - n + 1, n)
    return best


def matching(a: str, b: str, skip_frequent: bool = False) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of all blocks in order. Each level of the division is linear in what it still compares,
    so texts with d blocks take at most d passes. skip_frequent: blocks begin at characters that aren't frequent in b."""
    frequent = set()
    if skip_frequent and len(b) >= LONG:
        frequent = {c for c, n in Counter(b).items() if n > len(b) // SHARE + 1}
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        i, i_end, j, j_end = todo.pop()
        if i == i_end or j == j_end:
            continue
        x, y, n = _longest(a[i:i_end], b[j:j_end], frequent)
        x, y = x + i, y + j
        while x > i and y > j and a[x - 1] == b[y - 1]:
            x, y, n = x - 1, y - 1, n + 1
        while x + n < i_end and y + n < j_end and a[x + n] == b[y + n]:
            n += 1
        if n:
            found.append((x, y, n))
            todo += [(i, x, j, y), (x + n, i_end, y + n, j_end)]
    return sorted(found)


@F.pandas_udf(Y.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters by all characters; 1 of two empty texts, null where one is null."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 2.0 * sum(n for _, _, n in matching(x, y, True)) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.arrow_udf(Y.ArrayType(Y.StructType([Y.StructField(c, Y.IntegerType()) for c in "ijn"])))
def blocks(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matching blocks of two texts, null texts as empty ones. Texts are read one by one and a block takes three numbers, so
    a batch takes little more than its texts do."""
    offsets, numbers = array("i", [0]), array("i")
    for x, y in zip(a, b):
        for m in matching(x.as_py() or "", y.as_py() or ""):
            numbers.extend(m)
        offsets.append(len(numbers) // 3)
    flat = np.array(numbers, np.int32).reshape(-1, 3)
    found = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k]), pa.int32()) for k in range(3)], names=list("ijn"))
    return pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32), pa.int32()), found)


def gaps(found: Column, a: Column, b: Column) -> Column:
    """What lies before, between and after blocks: array of structs with the lengths in a and in b."""
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    ends = F.concat(F.array(place(F.lit(0), F.lit(0))), F.transform(found, lambda x: place(x["i"] + x["n"], x["j"] + x["n"])))
    size = lambda t: F.coalesce(F.length(t), F.lit(0))
    starts = F.concat(F.transform(found, lambda x: place(x["i"], x["j"])), F.array(place(size(a), size(b))))
    return F.zip_with(ends, starts, lambda e, s: F.struct((s["i"] - e["i"]).alias("a"), (s["j"] - e["j"]).alias("b")))
