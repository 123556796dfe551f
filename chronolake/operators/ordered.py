"""One ordered pass over the rows of each key, for state that depends on earlier output: linear in the rows, with one batch
and the state of one key in memory, however long a key's rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a batch that is handed on.
ROWS = 8192


def ordered_pass(df: DataFrame, key: str, order: list[str], columns: list[str | Column], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, placed: bool = False) -> DataFrame:
    """fold gets an iterator over one key's rows (key and columns) by ``order`` and yields rows of ``schema``; the key is put
    before them. Rows of a key lie in one sorted partition and are read as they come. placed: df comes from another pass by
    this key with projections only, so its rows lie and follow each other as they have to and aren't moved again."""
    fields = df.select(key).schema.fields + StructType(_parse_datatype_string(schema).fields).fields
    out = StructType(fields)
    arrow = to_arrow_schema(out, prefers_large_types=False)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held: list[tuple] = []
        for name, own in groupby(rows, itemgetter(0)):
            for r in fold(own):
                held.append((name, *r))
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    rows = df if placed else df.repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, *(F.col(c) if isinstance(c, str) else c for c in columns)).mapInArrow(run, out)
