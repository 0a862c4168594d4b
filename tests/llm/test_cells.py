"""Operator 9's cells: bounded groups in which every home point meets every point of its leaf."""

import random
from collections import Counter

import pytest

from pairweave.llm import simhash


def near_points(n):
    """Points of three low bits and few high ones: no vantage point parts them, and many lie within two bits."""
    rnd = random.Random(9)
    base = [rnd.getrandbits(63) for _ in range(n // 10)]
    return sorted({b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base for _ in range(9)} | set(base))


@pytest.mark.parametrize("cell", [1 << 21, 40, 7])
def test_groups_are_bounded_and_miss_no_pair(spark, cell):
    rows = [(0, p, i % 3 == 0) for i, p in enumerate(near_points(300))] + [(1, 5, False), (2, 6, True), (2, 7, False)]
    cells = simhash.cells_of(spark.createDataFrame(rows, "leaf long, fp long, home boolean").repartition(3), cell).collect()
    groups = {}
    for r in cells:
        groups.setdefault((r.leaf, r.h, r.s), []).append(r)
    met = Counter()
    for g in groups.values():
        if cell < 100:
            assert len(g) < 2 * (cell + 5 * cell**0.5 + 5)  # parts are even to chance
        for a in (r.fp for r in g if r.home):
            met.update((a, r.fp) for r in g if r.sent)
    assert met == {(a, b): 1 for leaf, a, home in rows if home for other, b, _ in rows if leaf == other}


@pytest.mark.parametrize("shard, cell", [(None, 1 << 21), (50, 20), (1 << 20, 25)])
def test_classes_in_any_cells(spark, shard, cell):
    points = near_points(400)
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {p: points[find(i)] for i, p in enumerate(points)}
    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(__import__("tempfile").mkdtemp(prefix="spark-"))
    got = {r.node: r.root for r in simhash.components(simhash.local_links(fps, 2, shard, cell)).collect()}
    assert {p: got.get(p, p) for p in points} == want
