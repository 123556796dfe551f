"""Token counts of byte-level BPE by a compiled finite-state transducer.

The split of a text into pretokens is a deterministic automaton over character classes (STEP).  A class
comes from the tokenizer itself: each code point is probed once.  A text is cut into chunks; for every
chunk the map from each entry state to its exit state is computed for all chunks at once, the maps are
composed by a parallel prefix scan, and with the entry states known a last pass marks where pretokens
start.  Within a pretoken a second transducer, compiled from the merges, runs over the bytes and adds up
the emitted-token counts that its transitions carry (merges.py); a distinct pretoken goes through it once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from . import regions as R
from .lexicon import Lexicon
from .memory import lean
from .merges import MergeTransducer

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 64

#: Classes of characters.
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Input symbols: a letter, a number, another character, one that may open a contraction of two or of
#: three characters, white space before more white space or the end, the last white space before a
#: visible character if it is a blank, and if it is not. Those that open a text have SYMBOLS added.
S_LETTER, S_NUMBER, S_OTHER, S_TWO, S_THREE, S_INNER, S_BLANK, S_LONE = range(8)
SYMBOLS = 8
#: States: in letters, numbers, other characters, white space; after a joining blank; one or two
#: characters of a contraction to come; after a contraction.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, JOIN, TWO_LEFT, ONE_LEFT, CLOSED = range(8)
STATES = 8
STARTS = 0x80


def _step(state: int, symbol: int) -> int:
    """Next state, with STARTS if a pretoken starts at this character."""
    if symbol >= SYMBOLS:
        state, symbol = CLOSED, symbol - SYMBOLS
    elif state in (TWO_LEFT, ONE_LEFT):
        return ONE_LEFT if state == TWO_LEFT else CLOSED
    if symbol in (S_LETTER, S_NUMBER):
        to = IN_LETTER if symbol == S_LETTER else IN_NUMBER
        return to if state in (to, JOIN) else to | STARTS
    if symbol in (S_OTHER, S_TWO, S_THREE):
        if state in (IN_OTHER, JOIN):
            return IN_OTHER
        return {S_OTHER: IN_OTHER, S_TWO: ONE_LEFT, S_THREE: TWO_LEFT}[symbol] | STARTS
    if symbol == S_INNER:
        return IN_SPACE if state == IN_SPACE else IN_SPACE | STARTS
    return (JOIN if symbol == S_BLANK else CLOSED) | STARTS


#: A contraction of two characters leaves one to come; the state then closes.
STEP = np.array([[_step(s, x) for s in range(STATES)] for x in range(2 * SYMBOLS)], np.uint8)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class CountTransducer:
    """Counts the tokens of texts. tokenizer: a byte-level BPE with the usual split and no normalizer."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.split = tokenizer.pre_tokenizer
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, 255, np.uint8)
        self.merges = MergeTransducer(path)
        # a lexicon keeps ids; one zero for each emitted token is enough for counts
        self.lexicon = Lexicon(lambda spans: [bytes(self.merges.count(s)) for s in spans])

    def _probe(self, code: int) -> int:
        c = chr(code)
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.split.pre_tokenize_str(before + c)) == 1:
                return kind
        return SPACE

    def symbols(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Input symbols of the code points of texts that start at rows[:-1]."""
        kinds = self.classes[points]
        if (kinds == 255).any():
            for code in np.unique(points[kinds == 255]).tolist():
                self.classes[code] = self._probe(code)
            kinds = self.classes[points]
        n = len(points)
        out = kinds.copy()  # the first three symbols have the classes' numbers
        at = np.flatnonzero(points == 0x27)
        if len(at):
            text_end = rows[np.searchsorted(rows, at, "right")]
            ahead = [np.where(at + d < text_end, points[np.minimum(at + d, n - 1)], 0) for d in (1, 2)]
            for c in CONTRACTIONS:
                hit = ahead[0] == ord(c[0])
                if len(c) == 2:
                    hit &= ahead[1] == ord(c[1])
                out[at[hit]] = S_TWO if len(c) == 1 else S_THREE
        space = kinds == SPACE
        last = space.copy()
        last[:-1] &= ~space[1:]
        last[rows[1:][rows[1:] > rows[:-1]] - 1] = False  # white space that ends a text is one run
        out[space] = S_INNER
        out[last] = S_LONE
        out[last & (points == 0x20)] = S_BLANK
        out[rows[:-1][np.diff(rows) > 0]] += SYMBOLS
        return out

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where pretokens start, by chunk maps and a prefix scan."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, S_INNER, np.uint8)
        padded[:n] = symbols
        grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
        table = STEP & np.uint8(STATES - 1)
        maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
        flat = table.ravel()
        for column in grid:
            maps = flat[(column.astype(np.int16)[:, None] << 3) | maps]
        step = 1
        while step < rows:  # composition of maps: after this, maps[i] leads from the start to the end of chunk i
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
            step *= 2
        state = np.append(np.uint8(CLOSED), maps[:-1, CLOSED])
        marks = np.empty((CHUNK, rows), bool)
        full = STEP.ravel()
        for k, column in enumerate(grid):
            got = full[(column.astype(np.int16) << 3) | state]
            marks[k] = got >= STARTS
            state = got & np.uint8(STATES - 1)
        return np.flatnonzero(marks.T.ravel()[:n])

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts at offsets in data."""
        raw = data[int(offsets[0]) : int(offsets[-1])].tobytes()
        base = offsets - offsets[0]
        extra = np.zeros(len(offsets) - 1, np.int64)
        if any(s in raw for s in self.special):
            return self._count_special(raw, base)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        part = np.frombuffer(raw, np.uint8)
        heads = np.flatnonzero((part & 0xC0) != 0x80)  # bytes at which code points start
        rows = np.searchsorted(heads, base)
        begin = self.starts(self.symbols(points, rows))
        if not len(begin):
            return extra
        at = heads[begin]
        slots = self.lexicon.slots(part, at, np.append(at[1:], len(part)))
        tokens = np.append(0, np.cumsum(self.lexicon.count[slots]))
        return np.diff(tokens[np.searchsorted(begin, rows)])

    def _count_special(self, raw: bytes, base: np.ndarray) -> np.ndarray:
        """The same where special tokens may occur: each counts one and parts the text."""
        out, plain, owner = np.zeros(len(base) - 1, np.int64), [], []
        for k, (a, b) in enumerate(zip(base[:-1].tolist(), base[1:].tolist())):
            pieces = [raw[a:b]]
            for s in self.special:
                pieces = [q for p in pieces for q in p.split(s)]
            out[k] += len(pieces) - 1
            plain += pieces
            owner += [k] * len(pieces)
        joined = np.frombuffer(b"".join(plain), np.uint8)
        lengths = np.append(0, np.cumsum([len(p) for p in plain]))
        keep, self.special = self.special, []
        try:
            np.add.at(out, owner, self.count(joined, lengths))
        finally:
            self.special = keep
        return out


@lru_cache(maxsize=4)
def _transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes (of UTF-8), n_tokens and over_limit (n_tokens > limit) to docs, replacing columns of
    these names.

    The tokens are the tokenizer's own, with special strings in texts as its default has them and nothing
    added, cut or padded. A null text is empty and has 0 tokens; an empty table stays empty; rows are
    independent of each other, so ties and repeats need no rule. A text is held whole by one worker.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("n_bytes", "n_tokens", "over_limit")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_bytes long, n_tokens long, over_limit boolean"])

    def count(batches):
        machine = _transducer(path)
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            tokens = [machine.count(data, offsets[i : j + 1]) for i, j in R.chunks(offsets, 1 << 20)]
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[*names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(lean(count), schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
