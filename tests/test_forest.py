"""Sums over flow forests by contraction, and small graphs ended in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.functions import graph
from floodgrid.operators import tilegraph


def plain_sums(nodes):
    nxt = {i: n for i, n, _ in nodes}
    total = {i: 0.0 for i, _, _ in nodes}
    for i, _, w in nodes:
        while i is not None:
            total[i] += w
            i = nxt[i]
    return total


def sums(spark, nodes, small):
    rows = list(nodes)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, next long, w double")
    return {r.id: r.total for r in tilegraph.forest_sums(df, small=small).collect()}


def forest(n, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(ids[i], ids[rng.randrange(max(0, i - 5), i)] if i and rng.random() > 0.03 else None, float(rng.randint(1, 9))) for i in range(n)]


def comb(n):
    """Side branches of two cells each on one stem."""
    stem = [(i, i - 1 if i else None, 1.0) for i in range(n)]
    return stem + [(n + 2 * i + k, i if k == 0 else n + 2 * i, 1.0) for i in range(n) for k in range(2)]


@pytest.mark.parametrize("make", [lambda: forest(400, 2), lambda: comb(60), lambda: [(i, i - 1 if i else None, 1.0) for i in range(300)], lambda: [(i, 0 if i else None, 2.0) for i in range(200)]])
def test_contraction_matches_plain_sums(spark, make):
    nodes = make()
    want = plain_sums(nodes)
    assert sums(spark, nodes, small=0) == want
    assert sums(spark, nodes, small=50) == want
    assert sums(spark, nodes, small=1 << 16) == want


def test_loops_end(spark):
    nodes = [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 2, 5.0), (4, 3, 1.0), (9, None, 2.0), (8, 9, 1.0)]
    got = sums(spark, nodes, small=0)
    # Nodes of the loop have no sum, however the graph is ended.
    assert got == {0: None, 1: None, 2: None, 3: 6.0, 4: 1.0, 9: 3.0, 8: 1.0} == sums(spark, nodes, small=1 << 16)


def test_one_stem_is_no_hot_key(spark):
    """A comb of many side branches: every task of every join has about the same number of rows."""
    n = 20_000
    ids = spark.range(n)
    stem = ids.select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("next"), F.lit(1.0).alias("w"))
    sides = ids.select((F.col("id") + n).alias("id"), F.col("id").alias("next"), F.lit(1.0).alias("w"))
    out = tilegraph.forest_sums(stem.unionByName(sides), small=0)
    wrong = out.where((F.col("id") < n) & (F.col("total") != 2.0 * (n - F.col("id"))) | (F.col("id") >= n) & (F.col("total") != 1.0))
    assert out.count() == 2 * n and wrong.isEmpty()


def test_first_targets_of_a_small_graph(spark):
    nodes = forest(300, 5)
    rng = random.Random(3)
    rows = [(i, n, i if rng.random() < 0.1 else None) for i, n, _ in nodes]
    df = spark.createDataFrame([*rows, (-1, -2, None), (-2, -1, None), (-3, 10**9, None)], "id long, next long, target long")
    few = {r.id: r.target for r in tilegraph.forest_roots(df).collect()}
    assert few == {r.id: r.target for r in tilegraph.forest_roots(df, small=0).collect()}
    assert few[-1] is None and few[-3] is None and sum(v is not None for v in few.values()) > 50


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_components_end_in_one_task(spark, keys):
    rng = np.random.default_rng(4)
    pairs = [(int(k), int(a), int(b)) for k, a, b in zip(rng.integers(0, 3, 250), rng.integers(0, 300, 250), rng.integers(0, 300, 250)) if a != b]
    df = spark.createDataFrame(pairs, "k int, a long, b long").select(*keys, "a", "b").distinct()
    one = sorted(map(tuple, graph.components(df, keys).collect()))
    assert one == sorted(map(tuple, graph.components(df, keys, small=0).collect()))
    assert one == sorted(map(tuple, graph.components(df, keys, small=60).collect())) and len(one) > 150
    assert graph.components(df.limit(0), keys).collect() == []
