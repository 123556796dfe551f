"""Ranked lexical search: block-max skipping over postings in variable blocks.

Documents are parted into shards as they are read, so postings are never shuffled.  A shard holds, for each
term that is asked for, the documents with the term in order of their ids, and how often they have it.  When
the statistics of all shards are known, each posting's share of a score is fixed, and dynamic programming
cuts each list into blocks so that the bounds of its blocks (their largest share) exceed the shares by as
little as possible for the blocks' number.  A search adds up the bounds of the blocks over each document,
takes the documents of the highest bounds first, and then goes through the others in order, skipping every
one whose bound can't reach the worst of the best so far.  What a shard returns is exact, so the best of all
shards' results are the best of all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import regions as R
from .memory import lean
from .store import saved

BEST = 10
#: Documents and postings of a shard, which a worker holds as arrays.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 21
#: What a block costs, in the unit of shares (a millionth of a term's weight at most), and the most postings of a block.
BLOCK_COST, BLOCK_MOST = 500_000, 64
#: Items of one pass over the documents.
PASS_ITEMS = 4096
#: Documents that are scored to find what the others have to reach.
SEEDS = 32
#: Tasks that merge the shards' results of an item before the last one does.
MERGERS = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, A to Z in lower case."""
    return _TERMS.findall((text or "").encode().translate(_FOLD.tobytes()))


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in data of the terms of consecutive texts, and the number of terms before each text."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = _TERM[data[lo:hi]]
    cut = np.zeros(hi - lo + 1, bool)
    cut[0] = cut[-1] = True
    cut[offsets - lo] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins) + lo
    return starts, np.flatnonzero(ends) + lo + 1, np.searchsorted(starts, offsets)


class Vocabulary:
    """Finds given terms among spans of text, by hash and then byte for byte."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        end = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)))
        begin = np.append(0, end[:-1])[: len(terms)]
        hashes = R.span_hashes(R._BYTE_HASH[data], begin, end, R._BASE_W) if terms else np.zeros(0, np.uint64)
        self.term = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.begin, self.size = hashes[self.term], data, begin, end - begin
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("terms repeat or have equal hashes")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the spans that are terms, and of their terms."""
        if not len(starts) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = int(starts[0]), int(ends[-1])
        part = _FOLD[data[lo:hi]]
        hashes = R.span_hashes(R._BYTE_HASH[part], starts - lo, ends - lo, R._BASE_W)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        span = np.flatnonzero(self.hashes[at] == hashes)
        term = self.term[at[span]]
        size = (ends - starts)[span]
        same = self.size[term] == size
        span, term, size = span[same], term[same], size[same]
        total = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        differs = part[np.repeat(starts[span] - lo - total, size) + step] != self.data[np.repeat(self.begin[term] - total, size) + step]
        if differs.any():
            wrong = np.unique(np.repeat(np.arange(len(span)), size)[differs])
            span, term = np.delete(span, wrong), np.delete(term, wrong)
        return span, term


_SHARD = "n_docs long, n_terms long, n_unnamed long, ids binary, lengths binary, terms array<int>, sizes array<int>, docs binary, counts binary"


class _Shard:
    """Postings of the documents that a task has read since the last shard."""

    def __init__(self):
        self.ids, self.lengths, self.docs, self.terms, self.counts = [], [], [], [], []
        self.size = self.postings = 0

    def add(self, ids: list[int | None], lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.ids += ids
        self.lengths.append(lengths)
        self.docs.append(doc + self.size)
        self.terms.append(term)
        self.counts.append(count)
        self.size += len(ids)
        self.postings += len(doc)

    def row(self) -> pa.RecordBatch:
        unnamed = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, unnamed))  # documents without an id are last
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc, term, count = place[np.concatenate(self.docs)], np.concatenate(self.terms), np.concatenate(self.counts)
        by_term = np.lexsort((doc, term))
        terms, sizes = np.unique(term, return_counts=True)
        lengths = np.concatenate(self.lengths)[order]
        values = [
            *([int(x)] for x in (len(ids), lengths.sum(), unnamed.sum())),
            [ids[order].tobytes()],
            [lengths.astype(np.int64).tobytes()],
            pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
            [doc[by_term].astype(np.int32).tobytes()],
            [count[by_term].astype(np.int64).tobytes()],
        ]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=[f.split()[0] for f in _SHARD.split(", ")])


def _shards(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Shards of docs (doc_id, text) with the postings of ``terms``; documents without any term are left out."""

    def run(batches):
        known, width, shard = Vocabulary(terms), max(1, len(terms)), _Shard()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = R.texts_of(batch.column("text"))
            for i, j in R.chunks(offsets):
                starts, ends, at = term_spans(data, offsets[i : j + 1])
                lengths = np.diff(at)
                has = np.flatnonzero(lengths)
                if not len(has):
                    continue
                span, term = known.find(data, starts, ends)
                doc = np.searchsorted(at, span, "right") - 1  # of the chunk
                key, count = np.unique((np.cumsum(lengths > 0) - 1)[doc] * width + term, return_counts=True)
                shard.add([ids[i + k] for k in has.tolist()], lengths[has], key // width, key % width, count)
                if shard.size >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield shard.row()
                    shard = _Shard()
        if shard.size:
            yield shard.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _SHARD)


def block_lengths(values: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, most: int = BLOCK_MOST) -> np.ndarray:
    """For lists that lie one after another in values: the length of the block that ends at each posting that
    ends one, else 0. The blocks minimise the sum of (largest value of the block - value) and of ``cost`` a block.

    The programme goes through all lists at once: at posting j of every list that has one, the best cut before it
    is chosen among the last ``most`` places.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    longest = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(longest), "left")  # lists that are longer than j
    spent = np.zeros(len(size), np.int64)
    before = np.full((len(size), most), np.iinfo(np.int64).max >> 1)  # cost of what is before a block that starts there
    largest = np.zeros((len(size), most), np.int64)
    column, rows = np.arange(most), np.arange(len(size))
    back = np.zeros(len(values), np.int64)
    for j in range(longest):
        n, p = left[j], j % most
        before[:n, p], largest[:n, p] = spent[:n], 0
        np.maximum(largest[:n], values[begin[:n] + j, None], out=largest[:n])
        length = (j - column) % most + 1
        whole = largest[:n] * length
        whole += before[:n]
        best = whole.argmin(axis=1)
        spent[:n] = whole[rows[:n], best] + cost
        back[begin[:n] + j] = length[best]
    out = np.zeros(len(values), np.int64)
    end = np.cumsum(sizes)
    at = end.copy()
    stop = end - sizes
    while len(at := at[live := at > stop]):
        stop = stop[live]
        out[at - 1] = back[at - 1]
        at = at - back[at - 1]
    return out


@dataclass(frozen=True)
class Query:
    item: int | None
    terms: np.ndarray
    weights: np.ndarray


class BlockedShard:
    """A shard with its postings' shares of a score, in blocks."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, shares: np.ndarray, n_docs: int, n_terms: int, cost: int = BLOCK_COST, most: int = BLOCK_MOST):
        self.n, self.docs, self.shares = n_docs, docs, shares
        self.slot = np.full(n_terms, -1)
        self.slot[terms] = np.arange(len(terms))
        self.begin = np.append(0, np.cumsum(sizes))
        length = block_lengths(shares, sizes, cost, most)
        last = np.flatnonzero(length)
        start = last - length[last] + 1
        self.first, self.last = docs[start].astype(np.int64), docs[last].astype(np.int64)
        self.largest = np.maximum.reduceat(shares, start) if len(start) else np.zeros(0, np.int64)
        self.blocks = np.searchsorted(start, self.begin)
        self.looked = 0  # at postings, by all searches

    def bounds(self, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Bound of every document's score: the weighted bounds of the blocks that lie over it."""
        a, n = self.blocks[slots], self.blocks[slots + 1] - self.blocks[slots]
        block = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        bound = np.repeat(weights, n) * self.largest[block]
        change = np.zeros(self.n + 1, np.int64)
        np.add.at(change, self.first[block], bound)
        np.subtract.at(change, self.last[block] + 1, bound)
        return np.cumsum(change[:-1])

    def scores(self, docs: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for s, w in zip(slots.tolist(), weights.tolist()):
            a, b = self.begin[s], self.begin[s + 1]
            own = self.docs[a:b]
            at = np.searchsorted(own, docs)
            at[at == len(own)] = 0
            hit = np.flatnonzero(own[at] == docs)
            out[hit] += w * self.shares[a + at[hit]]
        self.looked += len(docs) * len(slots)
        return out

    def _settle(self, docs: np.ndarray, upper: np.ndarray, slot: int, weight: int) -> None:
        """Puts a term's own share of the scores of docs (ascending) in upper, in place of its blocks' bounds."""
        a, b, p, q = self.begin[slot], self.begin[slot + 1], self.blocks[slot], self.blocks[slot + 1]
        own, shares = self.docs[a:b], self.shares[a:b]
        if len(docs) * 8 < len(own):  # few are left: only their blocks are looked at
            block = np.searchsorted(self.last[p:q], docs)
            over = np.flatnonzero(block < q - p)
            over = over[self.first[p + block[over]] <= docs[over]]
            at = np.searchsorted(own, docs[over])
            upper[over] -= weight * self.largest[p + block[over]]
            upper[over] += weight * np.where(own[at] == docs[over], shares[at], 0)
            self.looked += len(over)
            return
        at = np.minimum(np.searchsorted(docs, own), len(docs) - 1)
        hit = np.flatnonzero(docs[at] == own)
        upper[at[hit]] += weight * shares[hit]
        change = np.zeros(len(docs) + 1, np.int64)
        bound = weight * self.largest[p:q]
        np.subtract.at(change, np.searchsorted(docs, self.first[p:q]), bound)
        np.add.at(change, np.searchsorted(docs, self.last[p:q], "right"), bound)
        upper += np.cumsum(change[:-1])
        self.looked += len(own)

    def best(self, query: Query, k: int, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k documents of the highest scores above 0, equal scores by place.

        Terms are taken by what they can add at most. Before the first and after 1, 2, 4, ... of them the ``seeds``
        documents of the highest bounds are scored, and all whose bound is below the k-th best score are skipped.
        """
        slots = self.slot[query.terms]
        slots, weights = slots[slots >= 0], query.weights[slots >= 0]
        docs = scores = np.zeros(0, np.int64)
        if not len(slots):
            return docs, scores
        most = weights * np.maximum.reduceat(self.largest, self.blocks[:-1])[slots]
        order = np.argsort(-most, kind="stable")
        slots, weights = slots[order], weights[order]
        upper = self.bounds(slots, weights)
        left, least = np.flatnonzero(upper > 0), 1
        upper = upper[left]

        def keep(some: np.ndarray, own: np.ndarray) -> None:
            nonlocal docs, scores, least
            docs, scores = np.append(docs, some), np.append(scores, own)
            first = np.lexsort((docs, -scores))[:k]
            first = first[scores[first] > 0]
            docs, scores = docs[first], scores[first]
            if len(docs) == k:
                least = max(least, int(scores[-1]))

        for done, (s, w) in enumerate(zip(slots.tolist(), weights.tolist())):
            if done & (done - 1) == 0:  # 0, 1, 2, 4, ...
                top = np.sort(np.argpartition(-upper, seeds)[:seeds]) if len(left) > seeds else np.arange(len(left))
                keep(left[top], self.scores(left[top], slots, weights))
                upper[top] = 0
                live = upper >= least
                left, upper = left[live], upper[live]
            if not len(left):
                return docs, scores
            self._settle(left, upper, s, w)
        keep(left, upper)  # all terms are settled, so these are scores
        return docs, scores


def _searched(shards: DataFrame, queries: list[Query], n: int, total: int, width: int, k: int, cost: int, most: int) -> DataFrame:
    """The best documents of each query in each shard: item_id, doc_id, score. n documents have total terms."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths, counts = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "counts"))
                docs = np.frombuffer(row["docs"], np.int32)
                m = 100 - 75 + (75 * lengths * n) // total
                shares = (1_000_000_000 * counts) // (1000 * counts + 8 * m[docs])
                shard = BlockedShard(np.array(row["terms"], np.int64), np.array(row["sizes"], np.int64), docs, shares, len(ids), width, cost, most)
                named = len(ids) - row["n_unnamed"]
                item, doc, score = [], [], []
                for q in queries:
                    at, got = shard.best(q, k)
                    item += [q.item] * len(at)
                    doc += [int(ids[x]) if x < named else None for x in at.tolist()]
                    score += got.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], names=["item_id", "doc_id", "score"])

    return shards.mapInArrow(lean(run), "item_id long, doc_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked. A first merge by parts keeps what the last one reads small."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("part", F.spark_partition_id() % MERGERS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _passes(items: DataFrame, most: int) -> Iterator[dict[int | None, Counter]]:
    """Terms of items (item_id, text) and their repeats, at most about ``most`` items at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-items.count() // most))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    for p in range(parts):
        asked: dict[int | None, Counter] = {}
        for row in items.filter(part == p).collect():
            asked.setdefault(row.item_id, Counter()).update(terms_of(row.text))
        yield asked


def top_documents(docs: DataFrame, items: DataFrame, k: int = BEST, cost: int = BLOCK_COST, most: int = BLOCK_MOST, pass_items: int = PASS_ITEMS) -> DataFrame:
    """The k documents of docs (doc_id, text) with the highest scores above 0 for each of items (item_id, text):
    item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    A null or empty text has no terms; documents without terms don't count, items without terms have no rows.
    Rows of items with the same or a null item_id are one item with the terms of all of them. Rows of docs are
    documents of their own, with equal ids too; those without an id come after all others of equal score. Empty
    tables give no rows; other columns are ignored. Items are taken in passes of about ``pass_items``, each of
    which reads all documents; a shard of documents is held as arrays of some tens of MB.
    """
    spark, results = docs.sparkSession, []
    for asked in _passes(items, pass_items):
        terms = sorted(set().union(*asked.values()))
        number = {t: i for i, t in enumerate(terms)}
        shards = saved(_shards(docs, terms), "shards")
        n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        lists = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("l")).groupBy("l.terms").agg(F.sum("l.sizes").alias("df"))
        df = {r.terms: r.df for r in lists.collect()}  # a row for each term of the items
        queries = []
        for item, counts in asked.items():
            own = [(number[t], c * weight(n, df[number[t]])) for t, c in sorted(counts.items()) if number[t] in df]
            if own:
                queries.append(Query(item, np.array([t for t, _ in own]), np.array([w for _, w in own])))
        results.append(_searched(shards, queries, n, max(1, total), len(terms), k, cost, most))
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return _merged(found, k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t"
ORACLE_SQL = f"""
with a as (select doc_id, {_SQL_TERMS} from documents), q as (select item_id, t, count(*) as r from (select item_id, {_SQL_TERMS} from benchmark) group by 1, 2),
s as (select doc_id, count(*) as n from a group by 1), g as (select count(*)::bigint as docs, sum(n)::bigint as l from s),
p as (select doc_id, t, count(*) as tf from a where t in (select t from q) group by 1, 2), f as (select t, count(*) as df from p group by 1),
w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from f, g),
c as (select p.doc_id, p.t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l)) as share from p join s using (doc_id), g),
r as (select item_id, doc_id, sum(r * w * share)::bigint as score from q join w using (t) join c using (t) group by 1, 2),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""
