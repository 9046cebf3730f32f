"""Filling against plain priority flooding; invariants of breaching and flat routing."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.operators import conditioning, hydro
from floodgrid.operators.grid import Grid

H, W = 19, 22
G = Grid(W, H)
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def surface(seed, gaps=0.0, steps=None):
    rng = np.random.default_rng(seed)
    a = rng.random((H, W)) * 10
    if steps:
        a = np.floor(a / steps) * steps
    a[rng.random((H, W)) < gaps] = np.nan
    return a


def flood(a):
    out, heap = {}, []
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(~np.isnan(a)))}
    for r, c in cells:
        if any((r + i, c + j) not in cells for i, j in AROUND):
            out[r, c] = a[r, c]
            heapq.heappush(heap, (a[r, c], r, c))
    while heap:
        h, r, c = heapq.heappop(heap)
        for i, j in AROUND:
            n = (r + i, c + j)
            if n in cells and n not in out:
                out[n] = max(a[n], h)
                heapq.heappush(heap, (out[n], *n))
    return out


@pytest.mark.parametrize("seed,gaps,tile", [(1, 0.0, 5), (2, 0.08, 4), (3, 0.0, 64), (4, 0.03, 7)])
def test_fill_equals_priority_flood(spark, raster, seed, gaps, tile):
    a = surface(seed, gaps)
    got = {(r.row, r.col): r.filled for r in conditioning.fill_depressions(raster(a), G, tile).collect()}
    assert got == pytest.approx(flood(a))


def test_lowest_passes_on_a_chain(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (3, 4, 7.0), (4, -1, 2.0), (5, 1, 3.0), (5, -1, 9.0)], "a long, b long, w double")
    got = {r.node: r.level for r in conditioning.lowest_passes(edges).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 7.0, 4: 2.0, 5: 7.0}


@pytest.mark.parametrize("tile", [4, 64])
def test_flats_are_routed_out(spark, raster, tile):
    a = surface(7, steps=3.0)
    flow = conditioning.filled_flow(raster(a), G, tile).collect()
    nxt = {r.id: r.next for r in flow}
    for r in flow:
        border = r.row in (0, H - 1) or r.col in (0, W - 1)
        at, n = r.id, 0
        while nxt[at] is not None:
            at, n = nxt[at], n + 1
            assert n <= H * W
        assert border or r.next is not None


def test_breach_lowers_only_near_pits_and_independent_of_tiles(spark, raster):
    a = surface(11)
    results = []
    for tile in (4, 64):
        rows = conditioning.breach_depressions(raster(a), G, 4, tile).collect()
        results.append({(r.row, r.col): r.breached for r in rows})
        assert all(r.breached <= r.value for r in rows)
    assert results[0] == results[1]
    pits = [
        (r, c) for r in range(1, H - 1) for c in range(1, W - 1) if all(a[r + i, c + j] >= a[r, c] for i, j in AROUND)
    ]
    for (r, c), z in results[0].items():
        if z < a[r, c]:
            assert min(max(abs(r - p), abs(c - q)) for p, q in pits) <= 4


def test_breached_surface_has_fewer_pits(spark, raster):
    a = surface(12)
    count = lambda df: hydro.d8_pointer(df, G).where(
        (F.col("pointer") == 0) & F.col("row").between(1, H - 2) & F.col("col").between(1, W - 2)
    ).count()
    b = conditioning.breach_depressions(raster(a), G, 6).select("row", "col", F.col("breached").alias("value"))
    assert count(b) < count(raster(a))


def test_ways_out_miss_a_breach_that_changes_nothing(spark, raster, monkeypatch):
    from floodgrid.queries import terrain_queries

    dem = raster(surface(3))
    monkeypatch.setattr(terrain_queries.fx, "dem", lambda spark, sf: dem)
    monkeypatch.setattr(terrain_queries.fx, "grid", lambda spark, sf: G)
    good = terrain_queries.breaching_ways_out(spark, "").first()
    assert good.pits_in_reach > 10 and (good.stuck_pits, good.carved_pits) == (0, 0)
    monkeypatch.setattr(conditioning, "breach_depressions", lambda cells, grid, dist: cells.withColumn("breached", F.col("value")))
    idle = terrain_queries.breaching_ways_out(spark, "").first()
    assert idle.stuck_pits == idle.pits_in_reach == good.pits_in_reach
