"""Tiled flow, component and distance jobs against plain loops, with tiles far smaller than the grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.operators import distance, focal, hydro, outline
from floodgrid.operators.focal import dilate, median3, neighbourhood
from floodgrid.operators.grid import Grid
from floodgrid.functions.graph import components as graph_components
from floodgrid.operators.tilegraph import accumulate, first_downstream, label_components

H, W = 23, 17
G = Grid(W, H)


def random_surface(seed, gaps=0.1):
    rng = np.random.default_rng(seed)
    a = rng.random((H, W)) + 0.15 * np.arange(H)[:, None]
    a[rng.random((H, W)) < gaps] = np.nan
    return a


def steepest(a):
    nxt = {}
    for r, c in zip(*np.nonzero(~np.isnan(a))):
        best = (0.0, None)
        for code, (dr, dc) in hydro.D8.items():
            n = (r + dr, c + dc)
            if 0 <= n[0] < H and 0 <= n[1] < W and not np.isnan(a[n]):
                drop = (a[r, c] - a[n]) / np.hypot(dr, dc)
                if drop > best[0]:
                    best = (drop, n)
        nxt[r, c] = best[1]
    return nxt


@pytest.mark.parametrize("seed", [1, 2])
def test_accumulation_and_targets(spark, raster, seed):
    a = random_surface(seed)
    nxt = steepest(a)
    flow = hydro.with_next(hydro.d8_pointer(raster(a), G), G).cache()
    got = {(r.row, r.col): r.acc for r in hydro.flow_accumulation(flow, G, tile=5).collect()}
    want = dict.fromkeys(nxt, 0)
    for cell in nxt:
        at = cell
        while at is not None:
            want[at] += 1
            at = nxt[at]
    assert got == want
    stops = {k for k, v in want.items() if v >= 6}
    marked = flow.join(
        spark.createDataFrame([(int(r), int(c)) for r, c in stops], "row int, col int").withColumn("stop", F.lit(True)), ["row", "col"], "left"
    ).fillna(False, ["stop"])
    got = {r.id: r.target for r in first_downstream(marked, tile=5).collect()}
    for cell in nxt:
        at = cell
        while at is not None and at not in stops:
            at = nxt[at]
        assert got[cell[0] * W + cell[1]] == (None if at is None else at[0] * W + at[1])


def test_loops_stay_unresolved(spark):
    rows = [(0, 0, 0, 1, False), (1, 0, 1, 0, False), (2, 0, 2, 3, False), (3, 0, 3, None, True)]
    cells = spark.createDataFrame(rows, "id long, row int, col int, next long, stop boolean")
    for tile in (1, 2, 8):
        got = {r.id: r.target for r in first_downstream(cells, tile=tile).collect()}
        assert got == {0: None, 1: None, 2: 3, 3: 3}


def test_accumulation_of_weights_across_single_cell_tiles(spark):
    rows = [(i, 0, i, i + 1 if i < 9 else None, float(i)) for i in range(10)]
    cells = spark.createDataFrame(rows, "id long, row int, col int, next long, w double")
    got = {r.id: r.total for r in accumulate(cells, Grid(10, 1), tile=1).collect()}
    assert got == {i: sum(range(i + 1)) for i in range(10)}


def brute_labels(mask):
    label = {}
    for start in sorted(mask):
        if start in label:
            continue
        stack = [start]
        while stack:
            r, c = stack.pop()
            if (r, c) in label:
                continue
            label[r, c] = start[0] * W + start[1]
            stack += [n for n in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if n in mask and n not in label]
    return label


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_components(spark, tile):
    rng = np.random.default_rng(tile)
    masks = {k: {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((H, W)) < p))} for k, p in (("a", 0.35), ("b", 0.5))}
    df = spark.createDataFrame([(k, r, c) for k, m in masks.items() for r, c in m], "k string, row int, col int")
    got = {(r.k, r.row, r.col): r.label for r in label_components(df, G, ["k"], tile).collect()}
    assert got == {(k, r, c): v for k, m in masks.items() for (r, c), v in brute_labels(m).items()}


def test_graph_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in graph_components(edges, []).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("block", [5, 4096])
def test_distance_is_exact_and_anisotropic(spark, monkeypatch, block):
    monkeypatch.setattr(distance, "_BLOCK", block)
    rng = np.random.default_rng(5)
    g = Grid(W, H, res_x=2.5, res_y=-1.5)
    cells = [(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((H, W)) < 0.03))]
    got = distance.distance_to(spark.createDataFrame(cells, "row int, col int"), g).collect()
    assert len(got) == H * W
    for r in got:
        want = min(np.hypot((r.row - a) * 1.5, (r.col - b) * 2.5) for a, b in cells)
        assert r.dist == pytest.approx(want)


@pytest.mark.parametrize("block", [1, 7, 16])
@pytest.mark.parametrize("share", [0.002, 0.05])
def test_distance_by_column_blocks_equals_whole_rows(spark, block, share):
    rng = np.random.default_rng(block)
    g = Grid(W, H, res_x=2.5, res_y=-1.5)
    cells = [(k, int(r), int(c)) for k in (3, 4) for r, c in zip(*np.nonzero(rng.random((H, W)) < share))] + [(3, 1, W - 1)]
    mask = spark.createDataFrame(cells, "k int, row int, col int")
    want = {(r.k, r.row, r.col): r.dist for r in distance.distance_to(mask, g, "k", [3, 4]).collect()}
    got = distance.distance_to(mask, g, "k", [3, 4], block_cols=block).collect()
    assert len(got) == len(want)
    assert all(r.dist == want[r.k, r.row, r.col] for r in got)


def test_distance_on_a_long_row_keeps_tasks_small(spark):
    n = 300_000
    mask = spark.createDataFrame([(0, 5), (1, n - 1)], "row int, col int")
    got = distance.distance_to(mask, Grid(n, 2), block_cols=1 << 14)
    far = got.agg(F.count("*").alias("n"), F.max("dist").alias("d"), F.sum(F.abs(F.col("dist") - F.least(F.hypot("row", F.col("col") - 5), F.hypot(1 - F.col("row"), n - 1 - F.col("col"))))).alias("e")).first()
    assert far.n == 2 * n and far.e < 1e-6 and 149_000 < far.d < 151_000


def test_distance_to_nothing_has_no_rows(spark):
    assert distance.distance_to(spark.createDataFrame([], "row int, col int"), G).count() == 0


def test_square_reach_equals_dilation(spark):
    rng = np.random.default_rng(6)
    pick = lambda p: [(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((H, W)) < p))]
    q, t = pick(0.2), pick(0.02)
    qd, td = spark.createDataFrame(q, "row int, col int"), spark.createDataFrame(t, "row int, col int")
    steps = {(r.row, r.col): r.steps for r in distance.square_reach(qd, td, 4).collect()}
    for radius in (0, 1, 3, 4):
        grown = {(r.row, r.col) for r in dilate(td, radius, G).collect()}
        assert {k for k, v in steps.items() if v <= radius} == grown & set(q)


@pytest.mark.parametrize("block", [4, 4096])
def test_neighbourhood_keeps_diagonals_across_gaps(spark, raster, monkeypatch, block):
    monkeypatch.setattr(focal, "BLOCK", block)
    a = random_surface(9, gaps=0.5)
    p = np.pad(a, 1, constant_values=np.nan)
    for r in neighbourhood(raster(a)).collect():
        want = p[r.row : r.row + 3, r.col : r.col + 3].ravel()
        assert [None if np.isnan(x) else x for x in want] == list(r.nb)


def test_median_fills_gaps_of_the_domain(spark, raster):
    a = random_surface(3, gaps=0.4)
    domain = raster(np.zeros((H, W)))
    p = np.pad(a, 1, constant_values=np.nan)
    got = {(r.row, r.col): r.value for r in median3(raster(a), domain).collect()}
    for r in range(H):
        for c in range(W):
            w = p[r : r + 3, c : c + 3]
            if np.isnan(w).all():
                assert (r, c) not in got
            else:
                assert got[r, c] == pytest.approx(np.nanmedian(w))


def test_outlines_keep_area_and_holes(spark):
    ring = {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}
    touch = {(7, 7), (8, 8)}
    df = spark.createDataFrame([(0, r, c) for r, c in ring] + [(1, r, c) for r, c in touch], "label long, row int, col int")
    rings = outline.outline_rings(df, G).cache()
    got = {r.label: (r.rings, r.holes, r.area, r.perimeter) for r in outline.ring_measures(rings).collect()}
    # The two touching cells share a corner only and stay separate rings.
    assert got == {0: (2, 1, 24.0, 24), 1: (2, 0, 2.0, 8)}
    corners = {(r.label, r.ring): len(r.vertices) for r in outline.polygons(rings, G).collect()}
    assert sorted(corners.values()) == [4, 4, 4, 4]


def test_polygon_pieces_give_holes_to_their_shells(spark):
    """An island within a hole, two parts around a gap that meet by corners, a hole open to the outside by a corner."""
    art = ["#######..##", "#.....#.#.#", "#.###.#.##.", "#.#.#.#....", "#.###.#.##.", "#.....#.##.", "#######...#", "...........", "###........", "#.#........", "##........."]
    cells = [(r, c) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"]
    g = Grid(11, 11)
    mask = label_components(spark.createDataFrame(cells, "row int, col int"), g)
    rows = outline.polygon_pieces(mask, g, piece=3, tile=4).collect()
    rings = {}
    for r in sorted(rows, key=lambda r: (r.ring, r.piece)):
        rings.setdefault((r.part, r.ring, r.hole, r.shell), []).extend(tuple(v) for v in r.vertices)

    def area(v):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1])) / 2

    parts = {}
    for (part, ring, hole, shell), v in rings.items():
        assert (area(v) < 0) == hole and (ring == shell) != hole
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(v, v[1:] + v[:1]))
        parts.setdefault(part, []).append((hole, abs(area(v))))
    want = {0: [(False, 49.0), (True, 25.0)], 9: [(False, 3.0)], 19: [(False, 3.0)], 24: [(False, 9.0), (True, 1.0)], 52: [(False, 4.0)], 76: [(False, 1.0)], 88: [(False, 7.0)]}
    assert {p: sorted(v) for p, v in parts.items()} == want
    assert all(len(r.vertices) <= 3 for r in rows)
