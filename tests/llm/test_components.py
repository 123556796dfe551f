"""Components against union-find."""

from __future__ import annotations

import random

import pytest

from chronolake.llm.components import components

RANDOM = random.Random(3)
CASES = {
    "none": [],
    "loop": [(1, 1)],
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(0, i) for i in range(1, 600)],
    "random, repeated": [(RANDOM.randrange(400), RANDOM.randrange(400)) for _ in range(260)] * 2,
    "star around its largest": [(i, 700) for i in range(500)] + [(900, 3)],
}


def union(edges: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = CASES[name]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in found) == sorted(union(edges).items())


@pytest.mark.parametrize("name", ["chain", "random, repeated"])
def test_components_by_steps(spark, name):
    """Where a task contracts three edges at once, steps connect what is left."""
    edges, size = CASES[name], "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "3")
    try:
        found = components(spark.createDataFrame(edges, "a long, b long"), 3).collect()
    finally:
        spark.conf.unset(size)
    assert sorted((r.node, r.component) for r in found) == sorted(union(edges).items())
