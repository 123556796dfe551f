"""Exact removal of repeated byte strings by suffix sorting (external induced sorting)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions as R
from .memory import lean
from .suffix import join_strings, window_classes

WINDOW = 100
ANCHOR = 24
RESULT = ("kept", "n_bytes", "n_removed", "n_spans")


def classes_by_suffix_order(plan: R.Plan, strings: list[bytes], windows: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of strings in suffix order, and where each class of equal ones begins. Classes of one window in
    a string without copies are left out."""
    text, starts = join_strings(strings)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order, classes = window_classes(text, starts, lengths, plan.width)
    head = np.append(True, classes[1:] != classes[:-1]) if len(order) else np.zeros(0, bool)
    of = np.searchsorted(starts, order, "right") - 1
    keep = ~head | np.append(~head[1:], False) | (copies[of] > 1)
    number = order + (np.cumsum(windows) - windows - starts)[of]
    return number[keep], np.flatnonzero(head[keep])


def keyed(docs: DataFrame) -> DataFrame:
    """key, text and all other columns of docs as a struct ``row``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(R.NULL_ID)).alias("key"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))


def cover_lists(cover: DataFrame) -> DataFrame:
    return cover.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))


def ranges_of(column: pa.Array, i: int, j: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ranges of rows i to j, merged."""
    out = []
    for k in range(i, j):
        x = column[k].values if column[k].is_valid else None
        if x is None or not len(x):
            out.append((np.zeros(0, np.int64),) * 2)
        else:
            b, e = x.field(0).to_numpy(), x.field(1).to_numpy()
            out.append(R.merge_runs(np.zeros(len(b), np.int64), b, e)[1:])
    return out


def with_ranges(docs: DataFrame, plan: R.Plan, compare) -> DataFrame:
    """keyed(docs) with ``ranges``: what repeated windows cover in each document (null: nothing)."""
    source = keyed(docs)
    found = R.repeated_ranges(source, plan, compare)
    return source.join(cover_lists(found).hint("shuffle_merge"), F.col("key") == F.col("doc"), "left").select("row", "text", "ranges")


def own_columns(docs: DataFrame, new: tuple[str, ...]) -> list:
    """Fields of docs that are not replaced by new ones."""
    return [f for f in docs.schema.fields if f.name not in new]


def take(batch: pa.RecordBatch, fields: list, i: int, j: int) -> list[pa.Array]:
    """Columns of docs from rows of with_ranges."""
    rows = batch.column("row").slice(i, j - i)
    inner = dict(zip([f.name for f in rows.type], rows.flatten()))
    return [batch.column("text").slice(i, j - i) if f.name == "text" else inner[f.name] for f in fields]


def dedup_substrings(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Removes from each text every byte covered by a string of ``width`` bytes that also starts earlier.

    docs: doc_id, text and any other columns. Returns docs with (in place of columns of these names)
    ``kept`` (binary: the bytes left), n_bytes, n_removed, n_spans (maximal removed runs).

    Earlier means a smaller doc_id, or an earlier start in the same document. A null text is empty, a
    null doc_id is the smallest id; matches never cross documents; texts shorter than width stay whole.
    Rows that repeat a doc_id with the same text are one place: neither is earlier, both get the same
    result. With different texts under one id, what is found in either is removed from both. An empty
    table gives an empty table.
    """
    plan = R.Plan(width, min(ANCHOR, max(1, width // 3)), "byte", "later")
    fields = own_columns(docs, RESULT)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kept binary, n_bytes long, n_removed long, n_spans long"])

    def remove(batches):
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            for i, j in R.chunks(offsets, 8 << 20):
                kept, removed, spans = [], [], []
                for k, (begin, end) in zip(range(i, j), ranges_of(batch.column("ranges"), i, j)):
                    part = data[offsets[k] : offsets[k + 1]]
                    end = np.minimum(end, len(part))
                    begin, end = begin[begin < end], end[begin < end]
                    edge = np.zeros(len(part) + 1, np.int8)
                    edge[begin] += 1
                    edge[end] -= 1
                    kept.append(part[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes())
                    removed.append(int((end - begin).sum()))
                    spans.append(len(begin))
                yield pa.RecordBatch.from_arrays([*take(batch, fields, i, j), pa.array(kept, pa.binary()), pa.array(np.diff(offsets[i : j + 1])), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=[*(f.name for f in fields), "kept", "n_bytes", "n_removed", "n_spans"])

    return with_ranges(docs, plan, classes_by_suffix_order).mapInArrow(lean(remove), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_ranges(text: str | None, begin: np.ndarray, end: np.ndarray) -> str:
    """Text without the characters that ranges of bytes cover as a whole."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, np.minimum(begin, len(raw)), 1)
    np.add.at(edge, np.minimum(end, len(raw)), -1)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(heads):
        return ""
    whole = np.logical_and.reduceat(np.cumsum(edge[:-1]) > 0, heads)
    return raw[np.repeat(~whole, np.diff(np.append(heads, len(raw))))].tobytes().decode()


def dedup_texts(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with the text that dedup_substrings leaves, and n_chars, if there is one, to match. A character goes
    if all of its bytes are removed, so texts stay whole characters. No row goes; a null text stays null."""
    plan = R.Plan(width, min(ANCHOR, max(1, width // 3)), "byte", "later")
    fields = docs.schema.fields

    def remove(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(len(texts)):
                begin, end = ranges_of(batch.column("ranges"), k, k + 1)[0]
                if len(begin):
                    texts[k] = without_ranges(texts[k], begin, end)
            out = dict(zip([f.name for f in fields], take(batch, fields, 0, len(texts))))
            out["text"] = pa.array(texts, pa.string())
            if "n_chars" in out:
                kind = out["n_chars"].type
                out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], kind)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return with_ranges(docs, plan, classes_by_suffix_order).mapInArrow(lean(remove), docs.schema)
