"""Near-duplicates by BagMinHash: signatures of multisets of word shingles, banded and verified.

The weight of a shingle is its count in the text.  The weight axis is cut into dyadic intervals [0, 1),
[1, 2), [2, 4), ...; for each shingle and interval a Poisson process gives points in time, each with a
component of the signature and a place on the weight axis, and a point counts if its place is below the
shingle's weight.  A component takes the earliest point.  As the processes depend on shingle and interval
only, two texts agree in a component with the probability of their weighted Jaccard similarity.  The
points of a process are made in order of time and only as long as they can still be the earliest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions as R
from .components import components, join_copies
from .memory import lean
from .store import saved

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
#: 30 bands of 5: a pair at the threshold is missed with probability (1 - 0.8**5)**30 < 1e-5.
BANDS, BAND_ROWS = 30, 5
#: Texts and bytes of a block; what is left of a band is dealt to tasks by pairs of blocks.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
_STEP, _LEVEL, _PLACE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of consecutive texts; a text of fewer words than ``size`` (but some) is
    one shingle."""
    starts, ends, at = R.words_of(data, offsets)
    lo = int(offsets[0])
    words = R.span_hashes(R._BYTE_HASH[data[lo : int(offsets[-1])]], starts - lo, ends - lo, R._BASE_W)
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    first = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, R.span_hashes(words, first, np.minimum(first + size, at[1:][row]), R._BASE_S)


def weights(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and how often each occurs."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[head], hashes[head], np.diff(np.append(head, len(row)))


def signatures(row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, rows: int, size: int, slack: float = 4.0) -> np.ndarray:
    """Signatures (rows x size) of weighted sets; rows without elements get zeros."""
    out = np.zeros((rows, size), U)
    total = np.bincount(row, weight, rows)
    todo = total > 0
    while todo.any():
        limit = np.where(todo, (np.log(size) + slack) / np.maximum(total, 1), 0.0)
        use = todo[row]
        r, h, w = row[use], hashes[use], weight[use]
        parts, lows, rates = [(r, R.mix(h), w)], [np.zeros(len(r))], [np.ones(len(r))]
        low = 1
        while (w > low).any():  # the next interval is [low, 2 * low)
            up = w > low
            r, h, w = r[up], h[up], w[up]
            with np.errstate(over="ignore"):
                parts.append((r, R.mix(h + _LEVEL * U(low)), w))
            lows.append(np.full(len(r), float(low)))
            rates.append(np.full(len(r), float(low)))
            low *= 2
        r, seed, w = (np.concatenate(x) for x in zip(*parts))
        low_at, rate = np.concatenate(lows), np.concatenate(rates)
        time, bound = np.zeros(len(r)), limit[r]
        best = np.full(rows * size, np.inf)
        cells, times, names = [], [], []
        step = 0
        while len(r):
            step += 1
            with np.errstate(over="ignore"):
                draw = R.mix(seed + _STEP * U(step))
            time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * rate)
            live = time <= bound
            r, seed, w, low_at, rate, time, bound, draw = (x[live] for x in (r, seed, w, low_at, rate, time, bound, draw))
            name = R.mix(draw + _PLACE)
            cell = r * size + ((name >> U(32)) * U(size) >> U(32)).astype(np.int64)
            place = low_at + (name & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate
            counts = place < w
            cells.append(cell[counts])
            times.append(time[counts])
            names.append(name[counts])
        cell, time, name = (np.concatenate(x) for x in (cells, times, names))
        np.minimum.at(best, cell, time)
        first = time == best[cell]
        flat = np.zeros(rows * size, U)
        flat[cell[first]] = name[first]
        full = np.isfinite(best).reshape(rows, size).all(axis=1) & todo
        out[full] = flat.reshape(rows, size)[full]
        todo &= ~full
        slack += 6.0
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as sorted hashes and counts."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    union = int(a[1].sum() + b[1].sum()) - both
    return both / union if union else 0.0


def _profiles(docs: DataFrame) -> DataFrame:
    """key, a 128-bit name of the multiset of shingles (null: none) and band hashes."""

    def run(batches):
        salt = R.mix(np.arange(1, BANDS + 1, dtype=U))
        for batch in batches:
            data, offsets = R.texts_of(batch.column("text"))
            key = batch.column("key")
            for i, j in R.chunks(offsets):
                row, hashes = shingles(data, offsets[i : j + 1])
                row, hashes, weight = weights(row, hashes)
                n = j - i
                sig = signatures(row, hashes, weight, n, BANDS * BAND_ROWS).reshape(n, BANDS, BAND_ROWS)
                bands = np.broadcast_to(salt, (n, BANDS)).copy()
                for k in range(BAND_ROWS):
                    bands = R.mix(bands * U(0x9E3779B97F4A7C15) + sig[:, :, k])
                names = []
                for c in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)):
                    total = np.append(U(0), np.cumsum(R.mix(hashes ^ c) * (weight.astype(U) * U(2) + U(1))))
                    at = np.searchsorted(row, np.arange(n + 1))
                    names.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                some = np.bincount(row, minlength=n) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([key.slice(i, n), pa.array(names[0], mask=~some), pa.array(names[1]), lists], names=["key", "m1", "m2", "bands"])

    return docs.select("key", "text").mapInArrow(lean(run), "key long, m1 long, m2 long, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose multisets are similar."""

    def run(batches):
        for batch in batches:
            sets: list[list] = []
            for side in ("text_a", "text_b"):
                data, offsets = R.texts_of(batch.column(side))
                own = []
                for i, j in R.chunks(offsets):
                    row, hashes, weight = weights(*shingles(data, offsets[i : j + 1]))
                    at = np.searchsorted(row, np.arange(j - i + 1))
                    own += [(hashes[x:y], weight[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                sets.append(own)
            good = [weighted_jaccard(x, y) >= threshold for x, y in zip(*sets)]
            kept = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            yield kept

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def _candidates(task: np.ndarray, group: np.ndarray, side: np.ndarray, row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a task, of different groups (and sides, where a task has two), that may be similar. In an order
    that begins with a task's rarest shingles, similar texts share one of those that stand before the last
    threshold-th of their weight."""
    n = len(task)
    total = np.bincount(row, weight, n)
    two = np.zeros(int(task.max()) + 1, bool)
    two[task[side > 0]] = True
    order = np.lexsort((hashes, task[row]))
    name = np.cumsum(np.append(False, (np.diff(hashes[order]) != 0) | (np.diff(task[row][order]) != 0)))
    names = np.empty(len(row), np.int64)
    names[order] = name
    often = np.bincount(names)[names]
    order = np.lexsort((names, often, row))
    r, w = row[order], weight[order]
    before = np.cumsum(w) - w
    before -= np.repeat(before[np.searchsorted(r, np.arange(n))[np.bincount(r, minlength=n) > 0]], np.bincount(r, minlength=n)[np.bincount(r, minlength=n) > 0])
    use = (before <= total[r] - np.ceil(threshold * total[r] - 1e-6)) & (often[order] > 1)
    r, name = r[use], names[order][use]
    order = np.argsort(name, kind="stable")
    r, name = r[order], name[order]
    end = np.searchsorted(name, name, "right")
    found, held = [np.zeros(0, np.int64)], 0
    at, step = np.arange(len(r)), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        x, y = r[at], r[at + step]
        ok = (group[x] != group[y]) & ((side[x] != side[y]) | ~two[task[x]])
        ok &= np.minimum(total[x], total[y]) >= threshold * np.maximum(total[x], total[y]) - 1e-6
        x, y = x[ok], y[ok]
        found.append(np.minimum(x, y) * n + np.maximum(x, y))
        held += len(x)
        if held > 1 << 22:
            found = [np.unique(np.concatenate(found))]
            held = 0
        step += 1
    pairs = np.unique(np.concatenate(found))
    return pairs // n, pairs % n


def _linked(batches, threshold: float):
    """Of tasks (pairs of blocks of a band), links (a, b) that connect all groups that similar texts connect."""

    def settle(table: pa.Table):
        key, group, side = (table.column(c).to_numpy() for c in ("key", "group", "side"))
        task = np.unique(table.column("task").to_numpy(), return_inverse=True)[1]
        parts, done = [], 0
        for batch in table.select(["text"]).to_batches():
            data, offsets = R.texts_of(batch.column(0))
            for i, j in R.chunks(offsets):
                row, hashes, weight = weights(*shingles(data, offsets[i : j + 1]))
                parts.append((row + (done + i), hashes, weight))
            done += len(batch)
        row, hashes, weight = (np.concatenate(x) for x in zip(*parts))
        x, y = _candidates(task, group, side, row, hashes, weight, threshold)
        edge = np.searchsorted(row, np.arange(len(key) + 1))
        total = np.bincount(row, weight, len(key)).astype(np.int64)
        name = np.unique(hashes, return_inverse=True)[1]
        own = np.zeros(len(hashes) + 1, np.int64)  # weights of the text at hand, by shingle
        # a group is one in all tasks
        node = np.unique(group, return_inverse=True)[1]
        root = np.arange(len(node))
        heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        links = []
        for at, end in zip(heads.tolist(), np.append(heads[1:], len(x)).tolist()):
            i, others = int(x[at]), y[at:end]
            others = others[root[node[others]] != root[node[i]]]
            if not len(others):
                continue
            mine = slice(edge[i], edge[i + 1])
            own[name[mine]] = weight[mine]
            long = edge[others + 1] - edge[others]
            first = np.cumsum(long) - long
            cells = np.arange(int(long.sum())) + np.repeat(edge[others] - first, long)
            both = np.add.reduceat(np.minimum(own[name[cells]], weight[cells]), first)
            own[name[mine]] = 0
            near = others[both / (total[i] + total[others] - both) >= threshold]
            if len(near):
                met, one = np.unique(root[node[near]], return_index=True)
                links.append(np.sort(key[np.stack([np.full(len(one), i), near[one]])], axis=0))
                met = np.append(met, root[node[i]])
                root[np.isin(root, met)] = met.min()
        if links:
            a, b = np.concatenate(links, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        task = table.column("task").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for a, b in zip(edges[:-1], edges[1:]):
            if size > R.CHUNK_BYTES and held[-1].column("task")[-1].as_py() != task[a]:
                yield from settle(pa.concat_tables(held))
                held, size = [], 0
            if b > a:
                held.append(table.slice(a, b - a))
                size += int(pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0)
    if held:
        yield from settle(pa.concat_tables(held))


def _remaining(bands: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the members of a band that lie in different components and that no comparison with
    the band's lead has met. All such pairs are decided: the members are dealt to blocks, those of a large component
    to blocks of its own, and each pair of blocks is a task but those within a component."""
    size = texts.select(F.col("key").alias("node"), F.octet_length("text").cast("long").alias("bytes"))
    rest = bands.filter("key <> lead").join(groups, bands.key == groups.node, "left").select("band", "key", F.coalesce("component", "key").alias("group"))
    mixed = rest.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"), F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("h2"))
    # bands with the same members have the same pairs
    mixed = mixed.filter("low <> high").groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).select("band")
    rest = saved(rest.join(mixed, "band").join(size, F.col("key") == F.col("node")).select("band", "key", "group", "bytes"), "rest")
    number, total, size_of_rest = F.count(F.lit(1)), F.sum("bytes"), rest.count()
    large = rest.groupBy("band", "group").agg(number.alias("n"), total.alias("bytes")).filter((F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES)).select("band", "group", F.col("group").alias("owner"))
    rest = rest.join(large, ["band", "group"], "left").select("band", F.struct(F.col("owner").isNotNull().alias("large"), F.coalesce("owner", F.lit(0)).alias("id")).alias("owner"), "key", "group", "bytes")
    counts = rest.groupBy("band", "owner").agg(F.greatest(F.ceil(number / BLOCK), F.ceil(total / BLOCK_BYTES)).cast("int").alias("blocks"), number.alias("n"))
    rest = join_copies(rest, counts, ["band", "owner"], "n", size_of_rest).select("band", F.struct("owner", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("no")).alias("block"), "key", "group")
    blocks = counts.select("band", "owner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no")).select("band", F.struct("owner", F.col("no").cast("long").alias("no")).alias("block"))
    two = blocks.select("band", F.col("block").alias("x")).join(blocks.select("band", F.col("block").alias("y")), "band")
    two = two.filter("x <= y and not (x.owner.large and x.owner = y.owner)")
    task = F.xxhash64("band", "x", "y")
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side"))))
    dealt = two.select("band", task.alias("task"), F.explode(ends).alias("e")).select("band", "task", "e.block", "e.side")
    work = rest.join(dealt, ["band", "block"]).join(texts.select("key", "text"), "key").select("task", "key", "group", "side", "text").repartition("task").sortWithinPartitions("task")
    return work.mapInArrow(lean(lambda batches: _linked(batches, threshold)), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id with the same multiset of shingles),
    component_id (the smallest doc_id reachable by links of weighted Jaccard similarity >= threshold) and
    kept (doc_id is its component_id).

    Shingles are five consecutive words; a text of one to four words is one shingle. A null or empty text
    has none and is a component of its own. Rows that repeat a doc_id get the same ids. A null doc_id
    counts as the smallest and stays null. An empty table gives an empty table.

    Exact copies are classes from the start and take part once. Texts that share a band are compared with
    the band's smallest id; where that leaves a band in several components, all its other pairs of texts of
    different components are decided as well, block against block. So no link between texts that share a
    band is missed; a group of n texts that don't resemble each other costs tasks by the square of n / BLOCK.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(R.NULL_ID)).alias("key"), F.col("text").cast("string").alias("text"))
    profiles = saved(_profiles(source), "profiles")
    known = profiles.filter("m1 is not null")
    classes = known.groupBy("m1", "m2").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"))
    member = join_copies(known.select("key", "m1", "m2"), classes, ["m1", "m2"], "copies", known.count())
    member = saved(member.select("key", "class").distinct(), "classes")
    one = member.filter("key = class").select("key")
    bands = known.join(one, "key", "left_semi").select("key", F.explode("bands").alias("band"))
    many = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead")).filter("n > 1").select("band", "lead")
    bands = saved(bands.join(many, "band").select("band", "key", "lead").distinct(), "bands")
    involved = bands.select("key").distinct()
    texts = saved(source.join(involved, "key").dropDuplicates(["key"]), "texts")
    pairs = bands.filter("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    links = saved(_verified(pairs, texts, threshold), "links")
    groups = components(links)
    more = saved(_remaining(bands, groups, texts, threshold), "links")
    groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    found = member.join(groups, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    rows = source.select("key").join(found, "key", "left").select("key", F.coalesce("class", "key").alias("class"), F.coalesce("component", "key").alias("component"))
    whole = [F.when(F.col(c) != R.NULL_ID, F.col(c)).alias(n) for c, n in (("key", "doc_id"), ("class", "class_id"), ("component", "component_id"))]
    return rows.select(*whole, (F.col("key") == F.col("component")).alias("kept"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose document is kept by near_duplicates."""
    found = near_duplicates(docs.select("doc_id", "text"), threshold).filter("kept")
    kept = found.select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("__kept_id")), "left_semi")
