"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, join_copies, roots
from .memory import lean
from .regions import NULL_ID
from .store import saved

THRESHOLD = 0.93
#: Chance that a pair just at the threshold shares no bucket; closer pairs have less.
MISS = 0.0001
#: Vectors of a block; a bucket of more is dealt to tasks by pairs of blocks.
BLOCK = 1024
#: Vectors of a bucket that have nothing in common: blocks are multiplied faster than they are moved.
SHARED = 128
SEED = 7
LINKABLE = "label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(embedding, x -> x <> 0)"


def table_plan(most: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Signs of a code and number of tables for groups of up to ``most`` vectors: about SHARED vectors that
    have nothing in common share a code, and a pair at the threshold is missed with chance ``miss``. The more
    signs, the more tables are needed, and each table moves all vectors once."""
    bits = min(24, max(4, math.ceil(math.log2(max(most, SHARED) / SHARED))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows that have it and can be compared, and their unit vectors in double
    precision. Null and zero vectors and those with null or non-finite components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    out = []
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        vectors = values[first[rows][:, None] + np.arange(width)]
        scale = np.abs(vectors).max(axis=1)
        fine = np.isfinite(scale) & (scale > 0)
        rows, vectors = rows[fine], vectors[fine] / scale[fine, None]  # no overflow of squares
        out.append((rows, vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]))
    return out


def _codes(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """id, label, width and codes of the vectors that can be linked, and the codes as packed bytes."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            for rows, units in unit_vectors(batch.column("embedding")):
                n, width = units.shape
                if width not in planes:
                    planes[width] = np.random.default_rng(SEED).standard_normal((width, tables * bits))
                signs = (units @ planes[width] > 0).reshape(n, tables, bits)
                codes = (signs @ weights).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tables, pa.int32()), pa.array(codes.ravel()))
                packed = pa.array([c.tobytes() for c in codes.astype(_packed(bits))], pa.binary())
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(np.full(n, width), pa.int32()), lists, packed], names=["id", "label", "width", "codes", "packed"])

    return vectors.select("id", "label", "embedding").mapInArrow(lean(run), "id long, label long, width int, codes array<int>, packed binary")


def _packed(bits: int) -> np.dtype:
    return np.dtype("<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4")


def _compare(batches, threshold: float, bits: int):
    """For each task (pair of blocks of a bucket): how many vectors each row links with that no earlier
    table has found, and a root that connects what is linked."""

    def settle(table: pa.Table):
        key, copies, side = (table.column(c).to_numpy() for c in ("key", "copies", "side"))
        codes = np.frombuffer(b"".join(table.column("packed").to_pylist()), _packed(bits)).reshape(len(key), -1)
        turn = int(table.column("turn")[0].as_py())
        pairs = [np.zeros((2, 0), np.int64)]
        for rows, units in unit_vectors(table.column("embedding")):
            alone = not side[rows].any()
            left = np.flatnonzero(side[rows] == 0)
            right = left if alone else np.flatnonzero(side[rows] == 1)
            for a in range(0, len(left), BLOCK):
                i, j = np.nonzero(units[left[a : a + BLOCK]] @ units[right].T >= threshold - 1e-9)
                x, y = left[a : a + BLOCK][i], right[j]
                if alone:
                    x, y = x[x < y], y[x < y]
                exact = (units[x] * units[y]).sum(axis=1) >= threshold
                pairs.append(np.stack([rows[x[exact]], rows[y[exact]]]))
        x, y = np.concatenate(pairs, axis=1)
        new = ~(codes[x, :turn] == codes[y, :turn]).any(axis=1)
        x, y = x[new], y[new]
        if not len(x):
            return
        links = np.bincount(x, copies[y], len(key)) + np.bincount(y, copies[x], len(key))
        root = key[roots(len(key), x, y)]
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["key", "links", "root"])

    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        task = table.column("task").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[-1].column("task")[0].as_py() != task[a]:
                yield from settle(pa.concat_tables(held))
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
    if held:
        yield from settle(pa.concat_tables(held))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors: vec_id, embedding (array of float or double), label. One row per vector: vec_id, n_links (other
    vectors linked directly), component_id (smallest vec_id reachable by links) and kept (vec_id is its
    component_id).

    Vectors are linked if their labels are equal and not null and their cosine in double precision is
    threshold or more. Vectors that are null, zero, of another length or hold null or non-finite
    components link with nothing. Equal vectors of a label are one in the comparisons and count as many;
    rows that repeat a vec_id are vectors of their own, which share an id. A null vec_id counts as the
    smallest and stays null. An empty table gives an empty table.
    """
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("key"), "embedding", F.col("label").cast("long").alias("label"))
    name = [F.xxhash64("label", "embedding").alias("c1"), F.xxhash64(F.lit(1), "embedding", "label").alias("c2")]
    named = rows.select("*", *name)
    known = named.filter(LINKABLE)
    classes = saved(known.groupBy("c1", "c2").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label")), "classes")
    largest, total = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).agg(F.max("n"), F.sum("rows")).first()
    largest, total = largest or 0, total or 0
    bits, tables = table_plan(largest, threshold)
    one = join_copies(known, classes.select("c1", "c2", "class", "copies"), ["c1", "c2"], "copies", total).filter("key = class").dropDuplicates(["c1", "c2"])
    one = saved(one.select(F.xxhash64("c1", "c2").alias("id"), "key", "label", "embedding", "copies"), "vectors")
    # id tells classes apart where rows share a vec_id
    coded = saved(_codes(one.select("id", "label", "embedding"), bits, tables), "codes")
    buckets = coded.select("id", "label", "width", F.posexplode("codes").alias("turn", "code"))
    buckets = buckets.select("id", "turn", F.xxhash64("label", "width", "turn", "code").alias("bucket"))
    many = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = buckets.join(many, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod("id", F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("id", "turn", task.alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    work = dealt.join(one.select("id", "embedding", "copies"), "id").join(coded.select("id", "packed"), "id")
    work = work.select("task", F.col("id").alias("key"), "turn", "side", "copies", "embedding", "packed").repartition("task").sortWithinPartitions("task")
    found = saved(work.mapInArrow(lean(lambda batches: _compare(batches, threshold, bits)), "key long, links long, root long"), "links")
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    whole = one.select("id", F.col("key").alias("class")).join(groups, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("key"), "left")
    whole = whole.select("id", "class", F.coalesce("component", "id").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    least = whole.groupBy("group").agg(F.min("class").alias("component"))
    ids = classes.select("c1", "c2", "copies", F.xxhash64("c1", "c2").alias("id")).join(whole.join(least, "group"), "id").select("c1", "c2", "copies", "links", "component")
    # vectors that can't be linked keep to themselves, so they need no class
    inside = join_copies(known.select("key", "c1", "c2"), ids, ["c1", "c2"], "copies", total).select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component")
    outside = named.filter(f"not coalesce({LINKABLE}, false)")
    outside = outside.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    both = inside.unionByName(outside)
    named_ids = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(n) for c, n in (("key", "vec_id"), ("component", "component_id"))]
    return both.select(named_ids[0], "n_links", named_ids[1], (F.col("key") == F.col("component")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
