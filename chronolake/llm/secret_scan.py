"""Secret scans: patterns, and sliding-window entropy over candidate strings.

The patterns give the base spans.  The method adds spans of strings that look random: a candidate is a
maximal run of the characters of a class, a window slides over it, and the Shannon entropy of the window
follows from counts that change by one character in and one out.  Windows of enough entropy that hold
characters of every group the class asks for are joined to spans.  An allow-list of forms, and of words
that announce a digest, suppresses candidates that are known to be no secrets.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions as R
from .memory import lean

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
BASE_KINDS = (ASSIGN, ACCESS, HEX)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Least lengths of an assigned value, an access key and a hex string.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: What each assignment holds in lower case, and each access key as it is.
_WORDS, _MARK = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), b"AKIA"


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``characters`` are candidates; a window counts from ``bits`` of entropy a character on, if it
    holds one character of each of ``groups`` at least."""

    kind: str
    characters: str
    window: int
    bits: float
    groups: tuple[str, ...]


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    EntropyClass("entropy_hex", _DIGITS + "abcdefABCDEF", 24, 2.9, (_DIGITS, "abcdefABCDEF")),
    EntropyClass("entropy_base64", _DIGITS + _LOWER + _UPPER + "+/_=-", 20, 3.6, (_DIGITS, _LOWER, _UPPER)),
)
#: Forms of whole candidates that are no secrets: UUIDs, words joined by case or a mark, samples of
#: documentation, runs of the alphabet. Repeats are possessive, so a long candidate takes linear time.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    r"(?:[A-Z]?[a-z]{2,}+[0-9]{0,4}+[-_/=+]*+|[A-Z]{2,}+[-_/=+]++|[0-9]{1,4}+[-_/=+]++)++",
    r".*(?:EXAMPLE|example).*",
    r".*(?:0123456789|abcdefghij|ABCDEFGHIJ).*",
)
#: Words before a candidate that announce a digest.
ANNOUNCED = r"(?:sha-?\d*|md5|digest|checksum|etag|commit|integrity)[\"']?[\x20:=\"'-]*$"
_BEFORE = 32
#: Parts of a bit in which sums of c * log2(c) are kept, as integers, so they don't drift.
_SCALE = 1 << 40


def hot_windows(text: str, of: EntropyClass) -> list[tuple[int, int]]:
    """Maximal runs of the windows of text that count. One step a character, whatever the window."""
    n, w = len(text), of.window
    if n < w:
        return []
    sums = [0, 0, *(round(c * math.log2(c) * _SCALE) for c in range(2, w + 1))]
    most = math.floor(w * (math.log2(w) - of.bits) * _SCALE)
    counts: dict[str, int] = {}
    groups = [[0, frozenset(g)] for g in of.groups]
    total, found = 0, []
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += sums[c + 1] - sums[c]
        for g in groups:
            g[0] += new in g[1]
        if i < w - 1:
            continue
        if total <= most and all(g[0] for g in groups):
            if found and i - w + 1 <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([i - w + 1, i + 1])
        old = text[i - w + 1]
        c = counts[old]
        counts[old] = c - 1
        total -= sums[c] - sums[c - 1]
        for g in groups:
            g[0] -= old in g[1]
    return [tuple(x) for x in found]


class Scanner:
    def __init__(self, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, announced: str = ANNOUNCED):
        self.classes = [(c, re.compile(f"[{re.escape(c.characters)}]{{{c.window},}}")) for c in classes]
        self.allowed = [re.compile(a) for a in allowed]
        self.announced = re.compile(announced, re.IGNORECASE | re.ASCII)
        self.order = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in classes)))}
        # runs of bytes that are long enough to matter
        self.runs = [(_table("0123456789abcdef"), LEAST_HEX), *((_table(c.characters), c.window) for c in classes)]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), ASSIGN) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        found += [(m.start(), m.end(), ACCESS) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        return found + [(m.start(), m.end(), HEX) for m in _HEX.finditer(text) if len(m[0]) >= LEAST_HEX]

    def random(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for of, candidates in self.classes:
            for m in candidates.finditer(text):
                spans = hot_windows(m[0], of)
                if spans and not any(a.fullmatch(m[0]) for a in self.allowed) and not self.announced.search(text[max(0, m.start() - _BEFORE) : m.start()]):
                    found += [(m.start() + a, m.start() + b, of.kind) for a, b in spans]
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind) in code points, by start and kind; those of the method that lie inside
        one of a pattern are left out."""
        base = self.base(text)
        within = _Cover([(a, b) for a, b, _ in base])
        return sorted(base + [s for s in self.random(text) if not within(s[0], s[1])], key=lambda s: (s[0], self.order[s[2]]))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows of consecutive texts that can have spans: those with long runs or words of the patterns."""
        lo = int(offsets[0])
        part = data[lo : int(offsets[-1])]
        at = []
        for table, least in self.runs:
            inside = np.concatenate([[False], table[part], [False]])
            turns = np.flatnonzero(inside[1:] != inside[:-1])  # runs that cross texts are longer than each of theirs
            starts, ends = turns[::2], turns[1::2]
            for a, b in zip(starts[ends - starts >= least].tolist(), ends[ends - starts >= least].tolist()):
                at.append(np.arange(np.searchsorted(offsets, lo + a, "right") - 1, np.searchsorted(offsets, lo + b - 1, "right")))
        raw = part.tobytes()
        for where, words in ((raw.lower(), _WORDS), (raw, (_MARK,))):
            for word in words:
                hits, i = [], where.find(word)
                while i >= 0:
                    hits.append(i)
                    i = where.find(word, i + len(word))
                at.append(np.searchsorted(offsets, np.array(hits, np.int64) + lo, "right") - 1)
        return np.unique(np.concatenate(at))


class _Cover:
    """Whether a span lies inside one of the given ones."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = np.array([a for a, _ in spans], np.int64)
        self.reach = np.maximum.accumulate(np.array([b for _, b in spans], np.int64)) if spans else np.zeros(0, np.int64)

    def __call__(self, a: int, b: int) -> bool:
        k = int(np.searchsorted(self.starts, a, "right"))
        return k > 0 and int(self.reach[k - 1]) >= b


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


SPAN = "struct<kind:string,start:bigint,end:bigint>"


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, announced: str = ANNOUNCED) -> DataFrame:
    """Adds secrets to docs (replacing a column of that name): the spans of each whole text, kind, start and
    end in code points, by start and then kind.

    assign, access and hex are the matches of the patterns that are long enough, leftmost and not overlapping
    for each kind; the kinds of ``classes`` are added by entropy, unless inside one of a pattern. Letters of
    assignments are ASCII letters of either case. A null or empty text has no spans; rows are independent, so
    ties and repeats need no rule; an empty table stays empty; other columns pass through. A text is held
    whole by one worker, and time is linear in its length.
    """
    names = [c for c in docs.columns if c != "secrets"]
    fields = [docs.schema[c] for c in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"secrets array<{SPAN}>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(classes, allowed, announced)
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            found: list[list[dict]] = [[]] * len(batch)
            for i, j in R.chunks(offsets):
                for k in (i + scanner.rows(data, offsets[i : j + 1])).tolist():
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    found[k] = [{"kind": s[2], "start": s[0], "end": s[1]} for s in scanner.spans(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, kind)], names=[*names, "secrets"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), schema)


def digest(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.array_remove(F.col("secrets.kind"), k)) for k in BASE_KINDS]
    counts = [(F.size("secrets") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, BASE_KINDS)]
    return docs.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))
