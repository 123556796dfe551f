"""The rows of one key of a batch in order, with a bounded number of them in memory."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd

#: Rows that are sorted in memory, those that are read back at once, and those of a frame that is handed on.
HELD, BLOCK, ROWS = 50_000, 1000, 10_000


def in_order(frames: Iterator[pd.DataFrame], order: list[str], prepare: Callable[[pd.DataFrame], pd.DataFrame] = lambda f: f, held: int = HELD) -> Iterator[tuple]:
    """Named rows of all frames by ``order`` (equal ones as they came, missing values last). More rows than ``held`` are sorted in parts, which
    are kept in local files and merged. prepare: what is done to each sorted part."""
    part: list[pd.DataFrame] = []
    n, files = 0, []

    def cut() -> pd.DataFrame:
        return prepare((pd.concat(part, ignore_index=True) if len(part) > 1 else part[0]).sort_values(order, kind="stable"))

    def read(file) -> Iterator[tuple]:
        file.seek(0)
        for _ in range(pickle.load(file)):
            yield from pickle.load(file).itertuples(index=False, name="Row")

    def place(row: tuple) -> tuple:
        return tuple((v is None or v != v, 0 if v is None or v != v else v) for v in (getattr(row, c) for c in order))

    try:
        for frame in frames:
            part.append(frame)
            n += len(frame)
            if n >= held:
                files.append(tempfile.TemporaryFile())
                whole = cut()
                pickle.dump(-(-len(whole) // BLOCK), files[-1])
                for k in range(0, len(whole), BLOCK):
                    pickle.dump(whole.iloc[k : k + BLOCK], files[-1], pickle.HIGHEST_PROTOCOL)
                part.clear()
                n = 0
        last = cut().itertuples(index=False, name="Row") if part else iter(())
        yield from heapq.merge(*map(read, files), last, key=place) if files else last
    finally:
        for file in files:
            file.close()
