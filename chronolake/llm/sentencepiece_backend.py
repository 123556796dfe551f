"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file's protobuf is read here by its wire format.  From it the parts of a tokenizers pipeline
are rebuilt: the normaliser (only the identity and none of its options beyond the marker is supported,
anything else is refused), the metaspace marker, unigram scores or, for BPE models, the merges that the
scores imply, and byte fallback.  Batches are encoded by the library's threads.  No piece has a marker
after another character, so nothing is merged across the start of a run of blanks: texts are cut there,
and each distinct segment is encoded, decoded and compared with SentencePiece once for a worker.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers

from . import regions as R
from .lexicon import Lexicon
from .memory import lean

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
#: Fixed values of the format: field numbers of the model, of a piece, of the trainer and the normaliser.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SUFFIX_MARKER, UNK_SURFACE = 3, 35, 24, 44
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def message(raw: bytes) -> list[tuple[int, object]]:
    """Fields of a protobuf message: numbers as int, fixed 32 bits as float, the rest as bytes."""
    out, at = [], 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", raw, at)[0], at + 8
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        out.append((tag >> 3, value))
    return out


class Model:
    """What a model file says."""

    def __init__(self, raw: bytes):
        fields = message(raw)
        pieces = [dict(message(v)) for k, v in fields if k == PIECES]
        self.pieces = [p.get(PIECE_TEXT, b"").decode() for p in pieces]
        self.scores = [p.get(PIECE_SCORE, 0.0) for p in pieces]
        self.kinds = [p.get(PIECE_KIND, NORMAL) for p in pieces]
        trainer = dict(x for k, v in fields if k == TRAINER for x in message(v))
        normal = dict(x for k, v in fields if k == NORMALIZER for x in message(v))
        self.type = trainer.get(MODEL_TYPE, UNIGRAM)
        self.byte_fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        if normal.get(CHARSMAP) or normal.get(REMOVE_EXTRA, 1) or not normal.get(ESCAPE, 1) or trainer.get(SUFFIX_MARKER, 0):
            raise ValueError("only the identity normaliser with a leading marker is supported")
        if self.type not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.type}")
        if any(MARKER in p.lstrip(MARKER) for p in self.pieces) or USER_DEFINED in self.kinds:
            raise ValueError("pieces with a marker inside or user-defined pieces are not supported")

    def tokenizer(self) -> Tokenizer:
        if self.type == UNIGRAM:
            backend = models.Unigram(list(zip(self.pieces, self.scores)), self.kinds.index(UNKNOWN), self.byte_fallback)
        else:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
            merges = []
            for p in sorted((p for p in normal if len(p) > 1), key=lambda p: (-self.scores[normal[p]], normal[p])):
                merges += [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
            backend = models.BPE(vocab, merges, unk_token=self.pieces[self.kinds.index(UNKNOWN)], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(backend)
        out.normalizer = normalizers.Replace(" ", MARKER)
        out.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out


class Codec:
    """Encodes and decodes whole texts like the model's own library."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = Model(f.read())
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.backend = self.model.tokenizer()
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.differ: set[bytes] = set()
        self.lexicon = Lexicon(self._compile)

    def _compile(self, segments: list[bytes]) -> list[list[int]]:
        """Ids of segments that start with blanks (the first of which stands for the marker that the
        library adds itself) or, where none is added, of any."""
        texts = [s.decode() for s in segments]
        ids = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [t[1:] if self.model.prefix and t.startswith(" ") else t for t in texts]
        theirs = self.own.encode(cut, num_threads=2)
        back = self.backend.decode_batch(ids, skip_special_tokens=False)
        empty = [self.model.prefix and not c for c in cut]  # the library drops a marker alone
        for s, t, a, b, d, e in zip(segments, texts, ids, theirs, back, empty):
            if (a != b and not e) or d != t:
                self.differ.add(s)
        return ids

    def segments(self, data: np.ndarray, offsets: np.ndarray):
        """Texts with their added blank, joined; their offsets; and where segments start."""
        raw = data[int(offsets[0]) : int(offsets[-1])].tobytes()
        if MARKER.encode() in raw:  # the model takes a marker in a text for a blank
            at = offsets - offsets[0]
            parts = [raw[a:b].replace(MARKER.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts]))
        sizes = np.diff(offsets)
        lead = np.where(sizes > 0, int(self.model.prefix), 0)
        base = np.append(0, np.cumsum(sizes + lead))
        out = np.full(int(base[-1]), 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[base[:-1][lead > 0]] = False
        out[keep] = data[int(offsets[0]) : int(offsets[-1])]
        blank = out == 32
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[base[:-1][sizes > 0]] = True
        return out, base, np.flatnonzero(starts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their offsets, and which texts have a segment whose parity failed."""
        text, base, starts = self.segments(data, offsets)
        ends = np.append(starts[1:], len(text))
        slots = self.lexicon.slots(text, starts, ends)
        at = np.append(0, np.cumsum(self.lexicon.count[slots]))
        rows = np.searchsorted(starts, base)
        wrong = np.zeros(len(base) - 1, bool)
        if self.differ:
            raw = text.tobytes()
            for k, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                wrong[k] = any(raw[starts[i] : ends[i]] in self.differ for i in range(a, b))
        return self.lexicon.ids(slots), at[rows], wrong

    def decode(self, ids: list[list[int]]) -> list[str]:
        back = self.backend.decode_batch(ids, skip_special_tokens=False)
        return [t[1:] if self.model.prefix and t.startswith(" ") else t for t in back]


@lru_cache(maxsize=4)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds n_bytes, n_tokens, ids (array of int) and parity to docs, in place of columns of these names.

    parity: for every segment of the text the ids equal SentencePiece's and decode to the segment again.
    A null or empty text has no ids and parity; an empty table stays empty; rows are independent.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("n_bytes", "n_tokens", "ids", "parity")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_bytes long, n_tokens long, ids array<int>, parity boolean"])

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            for i, j in R.chunks(offsets, 1 << 20):
                ids, at, wrong = codec.encode(data, offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), pa.array(np.diff(offsets[i : j + 1])), pa.array(np.diff(at)), lists, pa.array(~wrong)], names=[*names, "n_bytes", "n_tokens", "ids", "parity"])

    return docs.mapInArrow(lean(run), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of the column ids (null: empty), in place of a column of that name."""
    fields = [f for f in rows.schema.fields if f.name != "decoded"]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded string"])

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            texts = codec.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(lean(run), schema)


def _digests(docs: DataFrame, path: str) -> DataFrame:
    """For the query: encode, and the checksum of the ids in place of them."""

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            for i, j in R.chunks(offsets, 1 << 20):
                ids, at, wrong = codec.encode(data, offsets[i : j + 1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(~wrong)], names=["doc_id", "n_bytes", "n_tokens", "ids_crc32", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, parity boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), parity."""
    import public_tokenizers

    return _digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
