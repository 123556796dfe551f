"""Spelling variants: words one edit apart, found by a join of their deletions, and the forms they lead to.

Every word emits itself and its distinct single deletions as keys.  Words at distance one share a key: the
shorter one, or what is left of both without the replaced letter.  The keys are joined, the distance is
verified, and the near words of each word are aggregated to its form; forms are then followed to roots by
joins that double their reach.

At most one key is shared by two such words.  If they differ by a letter in place i, and without letters p
and q they are equal as well, all letters between p and i of one of them are the same, so deleting p or i
gives the same key.  So the join returns each pair once.  A key belongs to few words however large the
table is: itself and one for each letter and place.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions as R
from .memory import lean
from .store import saved

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One of so many runs of a document loses a letter.
LOSS = 31
#: Words of more code points aren't carried along with their keys.
CARRIED = 128
#: Words that a worker counts before it hands them on.
HELD = 400_000
_FOLD = bytes([*range(0x41), *range(0x61, 0x7B), *range(0x5B, 0x100)])


def noisy(doc_id: str, run: str, loss: int = LOSS) -> str:
    """The run, without a letter if the checksum of its document and itself is divided by ``loss``."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % loss:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, loss: int = LOSS) -> DataFrame:
    """Words of docs (doc_id, text) of ``least_length`` code points that occur ``least_count`` times in all: word, n.

    Words are runs of letters, A to Z in lower case, one in ``loss`` without a letter. A null doc_id is an
    empty name in the checksum, a null or empty text has no words, and rows count by themselves, also with
    equal ids. Counts are summed up by each task before they are shuffled.
    """
    longest = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def run(batches):
        counts: dict[str, int] = {}
        own: dict[str, int] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = R.texts_of(batch.column("text"))
            for i, doc in enumerate(ids):
                text = data[offsets[i] : offsets[i + 1]].tobytes().translate(_FOLD).decode()
                own.clear()
                for w in longest.findall(text):
                    own[w] = own.get(w, 0) + 1
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), prefix)
                    if h % loss == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least_length:
                            continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= HELD:
                    yield flush()
        if counts:
            yield flush()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and 64-bit hash of each word and of its distinct single deletions, in time linear in
    the words' lengths. Deleting any of a run of equal letters gives the same, so the first stands for all."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    begin = end - size
    up, down = R.powers(R._BASE_W, len(points) + 2)
    before = np.concatenate([[np.uint64(0)], np.cumsum(R.mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])])
    first = np.ones(len(points), bool)
    first[1:] = points[1:] != points[:-1]
    first[begin[size > 0]] = True
    at = np.flatnonzero(first)
    word = np.searchsorted(end, at, "right")
    a, b = begin[word], end[word]
    # what is before the letter, and what is after it one place further to the front
    rest = (before[at] - before[a]) * down[a] + (before[b] - before[at + 1]) * down[a + 1]
    whole = (before[end] - before[begin]) * down[begin]
    numbers = np.concatenate([np.arange(len(words)), word])
    return numbers, R.mix(np.concatenate([whole, rest]) + np.concatenate([size, size[word] - 1]).astype(np.uint64))


def _keys(words: DataFrame, name: str) -> DataFrame:
    """key and the columns name and n for each key of words; name is carried, word is read."""
    kind = words.schema[name].dataType.simpleString()

    def run(batches):
        for batch in batches:
            numbers, keys = deletion_keys(batch.column("word").to_pylist())
            rows = pa.array(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(name).take(rows), batch.column("n").take(rows)], names=["key", name, "n"])

    return words.mapInArrow(lean(run), f"key long, {name} {kind}, n long")


def near_words(words: DataFrame) -> DataFrame:
    """Ordered pairs of the words (word, n; distinct) that differ by exactly one inserted, deleted or replaced
    code point: word, near, near_n. Keys are hashes of 64 bits; the distance is verified on the words."""
    verified = F.levenshtein("word", "near", 1) == 1
    short = _keys(words.filter(F.length("word") <= CARRIED), "word")
    pairs = short.join(short.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key").filter(F.col("word") != F.col("near")).filter(verified)
    pairs = pairs.select("word", "near", "near_n")
    # words of which one at least is long meet by name first, so that keys stay small
    rest = words.filter(F.length("word") >= CARRIED)
    if rest.filter(F.length("word") > CARRIED).isEmpty():
        return pairs
    named = rest.withColumn("name", F.sha2("word", 256))
    keys = _keys(named, "name")
    met = keys.select("key", F.col("name").alias("a")).join(keys.select("key", F.col("name").alias("b")), "key").filter("a <> b").select("a", "b").distinct()
    own, other = named.select(F.col("name").alias("a"), "word"), named.select(F.col("name").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    long = met.join(own, "a").join(other, "b").filter((F.length("word") > CARRIED) | (F.length("near") > CARRIED)).filter(verified)
    return pairs.unionByName(long.select("word", "near", "near_n"))


def followed(forms: DataFrame) -> DataFrame:
    """forms: word, form (not null, without cycles). word and root, where its forms end. Each join doubles the
    reach, and a form occurs ``TIMES`` as often as its word, so few joins are needed."""
    chain = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        chain = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return chain


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words: word, n (distinct words). Adds form, the near word of largest n (the smallest in code-point order
    of several), if that is ``times`` the word's n, else null; root, where forms lead to, the word itself if it
    has none; n_near, how many near words there are; form_n, the form's n or null.

    Null words have no near words and stay without a root; an empty table stays empty.
    """
    words = words.select("word", "n")
    near = near_words(words.filter("word is not null")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(near, "word", "left")
    most = -F.col("best.m")
    formed = most >= times * F.col("n")
    judged = saved(joined.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, most).alias("form_n")), "forms")
    roots = followed(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(saved(count_words(docs), "words"))
