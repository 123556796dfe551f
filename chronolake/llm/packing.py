"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import regions as R
from .lexicon import Lexicon
from .memory import lean
from .store import saved

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 2048, 0
#: A bin with less room than this is nearly full and final.
NEARLY = 48
#: Bins that a task hands on to the next round at most, those with most room first. No merge is lost by it.
#: After best-fit, longest first, at most one bin of a task is filled by half or less: the second one's first
#: item would have gone into the first. Two bins filled by more don't fit together, so a task of the next
#: round has at most FAN_IN bins to place, one of each task before, and needs no more hosts than that:
#: the roomiest ones hold whatever any others could.
HANDED_ON = 4096
FAN_IN = 8
#: Items of a task in the first round.
LOCAL_ITEMS = 20_000


@lru_cache(maxsize=4)
def _word_lexicon(path: str) -> Lexicon:
    """White space never enters a token of this kind of tokenizer, nor does anything cross it, so a text's
    ids are its words' ids."""
    tokenizer = Tokenizer.from_file(path)
    return Lexicon(lambda spans: [e.ids for e in tokenizer.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        lexicon = _word_lexicon(path)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            data, offsets = R.texts_of(batch.column("text"))
            for i, j in R.chunks(offsets, 1 << 20):
                starts, ends, at = R.words_of(data, offsets[i : j + 1])
                slots = lexicon.slots(data, starts, ends)
                flat = lexicon.ids(slots)
                ends_at = np.append(0, np.cumsum(lexicon.count[slots]))[at]
                flat = np.insert(flat, ends_at[1:], np.uint32(end_id))
                ends_at = ends_at + np.arange(j - i + 1)
                doc, piece, start, length, crc = [], [], [], [], []
                raw = memoryview(flat.astype("<u4").tobytes())
                for k, (a, b) in enumerate(zip(ends_at[:-1].tolist(), ends_at[1:].tolist())):
                    for p, s in enumerate(range(a, b, capacity)):
                        e = min(b, s + capacity)
                        doc.append(ids_of[i + k])
                        piece.append(p)
                        start.append(s - a)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that holds it."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    have = 0  # bit r: some bin has room r
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fit = have >> n
        if fit:
            r = n + ((fit & -fit).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                have &= ~(1 << r)
        else:
            r, b = capacity, len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        r -= n
        if r:
            room[r].append(b)
            have |= 1 << r
    return bins, offsets


def _round(units: DataFrame, tasks: int, capacity: int, level: int, last: bool) -> DataFrame:
    """Packs units (unit, length, part) within each of ``tasks`` parts: unit, length, bin, offset, and what
    becomes of the bin: its fill and whether it goes on."""

    def pack(batches):
        parts = [b for b in batches]
        table = pa.Table.from_batches(parts).to_pandas() if parts else pd.DataFrame(columns=["unit", "length", "part"])
        for part, own in table.sort_values(["part", "unit"], kind="stable").groupby("part", sort=True):
            lengths = own.length.to_numpy().astype(np.int64)
            bins, offsets = best_fit(lengths, capacity)
            fill = np.bincount(bins, lengths).astype(np.int64)
            on = np.zeros(len(fill), bool)
            if not last:
                open_bins = np.flatnonzero(capacity - fill >= NEARLY)
                on[open_bins[np.argsort(fill[open_bins], kind="stable")][:HANDED_ON]] = True
            name = (np.int64(level) << np.int64(58)) | (np.int64(part) << np.int64(34))
            yield pa.RecordBatch.from_arrays([pa.array(own.unit.to_numpy()), pa.array(name + bins), pa.array(offsets), pa.array(fill[bins]), pa.array(on[bins])], names=["unit", "bin", "at", "fill", "goes_on"])

    return units.repartition(tasks, "part").mapInArrow(lean(pack), "unit long, bin long, at long, fill long, goes_on boolean")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """Adds sequence_id and offset to pieces (with length <= capacity): few sequences, each filled without
    gaps from 0.

    Parts of about local_items pieces are packed by themselves. Nearly full bins are final; the others
    become items of the next round, in which FAN_IN parts meet, until one part is left. A bin that goes
    on keeps its items together. Pieces of full length are sequences of their own and are not moved.
    """
    pieces = saved(pieces.withColumn("__unit", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity).select(F.col("__unit").alias("unit"), "length")
    count = short.count()
    parts = max(1, -(-count // local_items))
    units = short.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)))
    level, placed = 1, None
    while True:
        last = parts == 1
        made = saved(_round(units, parts, capacity, level, last), "packed")
        if placed is None:
            placed = made.select(F.col("unit").alias("__unit"), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
        else:
            moved = made.select(F.col("unit").alias("sequence_id"), F.col("bin").alias("to"), "at")
            placed = placed.join(moved, "sequence_id", "left").select("__unit", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
        if last:
            break
        units = made.filter("goes_on").groupBy(F.col("bin").alias("unit")).agg(F.max("fill").alias("length")).select("unit", "length", F.floor(F.shiftright(F.col("unit"), 34).bitwiseAND(F.lit((1 << 24) - 1)) / FAN_IN).alias("part"))
        parts, level = -(-parts // FAN_IN), level + 1
    full = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.col("__unit"), "offset": F.lit(0).cast("long")})
    rest = pieces.join(placed, "__unit")
    return full.select(rest.columns).unionByName(rest).drop("__unit")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes docs (doc_id, text), cuts what is longer than ``capacity`` and packs all pieces: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``, so a null or empty text is one token. Each row is a document of
    its own, rows with the same or a null doc_id too; an empty table has no pieces. Ties in length are
    packed in the order of rows.
    """
    return pack_pieces(token_pieces(docs, path, capacity, end_id), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))
