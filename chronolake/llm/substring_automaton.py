"""Removal of recurring passages by sharded Aho-Corasick automata over words."""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions as R
from .memory import lean
from .substring_suffix import own_columns, ranges_of, take, with_ranges

WINDOW = 35
ANCHOR = 11
RESULT = ("kept", "n_words", "n_removed")


#: Words that one code point can name, and bits of the second of two, which lies above all first ones.
ONE_POINT, LOW_BITS = 1_112_000, 15


def _symbols(strings: list[bytes], most: int = ONE_POINT) -> tuple[list[str], int]:
    """Each string as text in which every word has a name of as many code points, and how many these are: one, or two where
    there are more than ``most`` words. The second point of a name is no first one, so names are found at their places only."""
    ids: dict[bytes, int] = {}
    numbers = [[ids.setdefault(w, len(ids) + 1) for w in s.split()] for s in strings]
    if len(ids) <= most:
        name = {n: chr(n if n < 0xD800 else n + 0x800) for n in ids.values()}
        return ["".join([name[n] for n in own]) for own in numbers], 1
    first, second = 1 << LOW_BITS, (1 << LOW_BITS) - 1
    if len(ids) >> LOW_BITS >= first:
        raise ValueError("more words than names")
    name = {n: chr((n >> LOW_BITS) + 1) + chr(0x10000 + (n & second)) for n in ids.values()}
    return ["".join([name[n] for n in own]) for own in numbers], 2


def recurring_passages(texts: list[str], copies: list[int], width: int, points: int = 1) -> list[str]:
    """The longest phrases that recur as a whole: runs of windows at two places or more, of which each is
    always followed by the next. So every place of a recurring window lies in a place of its passage.
    points: code points of a word's name."""
    seen, joined = Counter(), Counter()
    step, size = points, points * width
    for t, n in zip(texts, copies):
        for k in range(0, len(t) - size + 1, step):
            seen[t[k : k + size]] += n
        for k in range(0, len(t) - size, step):
            joined[t[k : k + size + step]] += n
    found: dict[str, None] = {}
    for t in texts:
        k, last = 0, len(t) - size
        while k <= last:
            n, end = seen[t[k : k + size]], k
            if n > 1:
                while end < last and seen[t[end + step : end + step + size]] == joined[t[end : end + size + step]] == n:
                    end += step
                found[t[k : end + size]] = None
            k = end + step
    return list(found)


def classes_by_automaton(plan: R.Plan, strings: list[bytes], windows: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of strings that lie in an occurrence of a recurring passage, by passage and place in it, and
    where each such class begins. The occurrences come from an automaton over all passages."""
    texts, points = _symbols(strings)
    automaton = ahocorasick.Automaton()
    sizes = []
    for passage in recurring_passages(texts, copies.tolist(), plan.width, points):
        automaton.add_word(passage, (len(sizes), len(passage)))
        sizes.append(len(passage) // points - plan.width + 1)
    if not sizes:
        return (np.zeros(0, np.int64),) * 2
    automaton.make_automaton()
    hits = [(number, b + (end - length + 1) // points) for b, t in zip((np.cumsum(windows) - windows).tolist(), texts) for end, (number, length) in automaton.iter(t)]
    passage, at = np.array(hits, np.int64).T
    size = np.array(sizes)[passage]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    numbers, classes = np.repeat(at, size) + place, np.repeat((np.cumsum(sizes) - sizes)[passage], size) + place
    order = np.lexsort((numbers, classes))
    return numbers[order], np.flatnonzero(np.append(True, np.diff(classes[order]) != 0))


def remove_passages(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Removes each word covered by a window of ``width`` words whose words also start anywhere else, the
    same document included; all occurrences go, the first too.

    Words are runs of characters other than space and tab to carriage return, taken unchanged. Returns
    docs with (in place of columns of these names) ``kept`` (binary: the words left, joined by one space),
    n_words and n_removed. Recurring passages are confirmed in the shard of their anchor and compiled there;
    the text that documents have around that anchor streams through the shard's automaton, copies of it as one.

    A null text has no words; texts shorter than width stay whole; a null doc_id is an id of its own.
    Rows that repeat a doc_id share one result and count as places of their own, so a row given twice
    loses every window. An empty table gives an empty table.
    """
    plan = R.Plan(width, min(ANCHOR, max(1, width // 3)), "word", "any")
    fields = own_columns(docs, RESULT)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kept binary, n_words long, n_removed long"])

    def remove(batches):
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            for i, j in R.chunks(offsets):
                starts, ends, at = R.words_of(data, offsets[i : j + 1])
                edge = np.zeros(len(starts) + 1, np.int32)
                for k, (begin, end) in enumerate(ranges_of(batch.column("ranges"), i, j)):
                    last = at[k + 1] - at[k]
                    np.add.at(edge, at[k] + np.minimum(begin, last), 1)
                    np.add.at(edge, at[k] + np.minimum(end, last), -1)
                keep = np.cumsum(edge[:-1]) == 0
                lengths = (ends - starts)[keep] + 1
                out = np.cumsum(lengths) - lengths
                index = np.repeat(starts[keep] - out, lengths) + np.arange(int(lengths.sum()))
                text = np.append(data, np.uint8(32))[index] if int(lengths.sum()) else np.zeros(0, np.uint8)
                text[out + lengths - 1] = 32
                raw = text.tobytes()
                edges = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(keep))[at]]
                kept = [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                n_words = np.diff(at)
                left = np.diff(np.append(0, np.cumsum(keep))[at])
                yield pa.RecordBatch.from_arrays([*take(batch, fields, i, j), pa.array(kept, pa.binary()), pa.array(n_words.astype(np.int64)), pa.array((n_words - left).astype(np.int64))], names=[*(f.name for f in fields), "kept", "n_words", "n_removed"])

    return with_ranges(docs, plan, classes_by_automaton).mapInArrow(lean(remove), schema)


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
