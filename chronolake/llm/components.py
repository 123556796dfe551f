"""Connected components: edges are contracted by each task, then by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .store import saved

#: Edges that a task contracts at once.
CONTRACTED = 1 << 20

#: Nodes are hot that have more edges than both HOT_EDGES and a MOST_HOT-th of all.
HOT_EDGES, MOST_HOT = 256, 4096


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of the connected part of each of n nodes."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """Edges (a, b), a > b, from each node to the smallest that the edges a task holds at once connect it with: they
    connect the same nodes as before, are no more, and are far fewer where a task has many edges of a component."""

    def settle(held):
        a, b = (np.concatenate([t.column(c).to_numpy() for t in held]) for c in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(len(nodes), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= most:
                yield settle(held)
                held, size = [], 0
        if held:
            yield settle(held)

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges (a, b) and that of nodes that keep them from being stars: those with several edges to smaller
    nodes and those with edges of both kinds. Edges to a smaller node that are stars are components with their least node."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    total, open_nodes = nodes.agg(F.sum("down"), F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()
    return total or 0, open_nodes


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Adds m, the least of a, to edges (a, b). least: u, m, n (the number of u's edges, total in all). Nodes that have
    more than a MOST_HOT-th of all edges are MOST_HOT at most: they are broadcast, so their edges stay where they are."""
    hot = least.filter(F.col("n") > max(HOT_EDGES, total // MOST_HOT)).select(F.col("u").alias("hot"), F.col("m").alias("hot_m"))
    marked = edges.join(F.broadcast(hot), edges.a == F.col("hot"), "left")
    met = marked.filter("hot is not null").select("a", "b", F.col("hot_m").alias("m"))
    return met.unionByName(marked.filter("hot is null").select("a", "b").join(least.select("u", "m"), F.col("a") == F.col("u")).select("a", "b", "m"))


def join_copies(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows joined with groups, which has one row for each of the keys and in column ``copies`` how many of the rows
    have them. As above, groups that are hot are broadcast, so their rows stay where they are."""
    limit = max(HOT_EDGES, total // MOST_HOT)
    hot = groups.filter(F.col(copies) > limit)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(groups.filter(F.col(copies) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def components(edges: DataFrame, contracted: int = CONTRACTED) -> DataFrame:
    """edges: a, b (long, undirected). Returns node and component, the smallest node reachable, for every node
    that an edge with different ends has. No edges give no rows; loops and repeated edges are ignored.

    Edges are first replaced by the stars of ``contracted`` at a time, before anything is shuffled, so few steps are
    left, and none where that many hold all. Minima are aggregated before they are shuffled, and edges of nodes with
    very many neighbours meet them by broadcast, so such a node is no hot key. Steps end when all edges are stars.
    """
    pairs = saved(_contracted(edges.filter("a <> b"), contracted), "edges")
    # files are read together, without a shuffle, by tasks of about ``contracted`` edges each
    tasks = -(-pairs.count() // contracted) or 1
    pairs = saved(_contracted(pairs.coalesce(tasks), contracted).distinct(), "edges")
    total, open_nodes = _state(pairs)
    own = [F.min("b").alias("m"), F.count(F.lit(1)).alias("n")]
    while open_nodes:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(*own).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(*own)
        moved = _with_least(large, least, total).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = saved(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        total, open_nodes = _state(pairs)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
