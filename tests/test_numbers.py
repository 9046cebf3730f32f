"""Percentiles, ranks, hazard curves, projection, overlay and nearest neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.functions import hazard, quantiles
from floodgrid.functions.projection import lonlat_to_utm
from floodgrid.functions.ranking import global_rank
from floodgrid.operators import altimetry, hydro, polygon_overlay, vector
from floodgrid.operators.grid import Grid

PROBS = {"a": 0.0, "b": 0.01, "c": 0.333, "d": 0.5, "e": 0.999, "f": 1.0}


def test_percentiles_in_ranges(spark):
    """Groups larger than a range, of one value, of ties, and without a key."""
    rng = np.random.default_rng(1)
    data = {"skew": rng.lognormal(0, 3, 4000), "one": np.array([2.5]), "ties": np.repeat([1.0, 2.0, 7.0], 300)}
    data[None] = np.array([3.0, 4.0])
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("ties", None)], "k string, x double")
    got = {r.k: r for r in quantiles.group_percentiles(df, ["k"], "x", PROBS).collect()}
    for k, v in data.items():
        assert [got[k][n] for n in PROBS] == pytest.approx(list(np.percentile(v, [100 * p for p in PROBS.values()])))


def test_percentiles_of_nothing(spark):
    assert quantiles.group_percentiles(spark.createDataFrame([], "x double"), [], "x", {"m": 0.5}).count() == 0


def test_global_rank(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    got = {r.id: r.n for r in global_rank(df, [F.desc("v"), F.asc("id")], "n").collect()}
    want = sorted(range(5000), key=lambda i: (-(i * 7919 % 101), i))
    assert got == {i: n for n, i in enumerate(want, 1)}


# Published membership per depth for spreads 1.75 and 2.5 at midpoint 1.125.
FUZZY = [
    (0.125, 0.021, 0.004),
    (0.25, 0.067, 0.023),
    (0.5, 0.195, 0.116),
    (0.75, 0.330, 0.266),
    (1.0, 0.449, 0.427),
    (1.125, 0.500, 0.500),
    (1.5, 0.623, 0.672),
    (2.0, 0.732, 0.808),
    (3.0, 0.848, 0.921),
]


@pytest.mark.parametrize("depth,low,high", FUZZY)
def test_fuzzy_large_table(spark, depth, low, high):
    row = spark.range(1).select(
        hazard.fuzzy_large(F.lit(depth), 1.125, 1.75).alias("a"), hazard.fuzzy_large(F.lit(depth), 1.125, 2.5).alias("b")
    ).first()
    assert (round(row.a, 3), round(row.b, 3)) == (low, high)


def test_fuzzy_large_edges(spark):
    row = spark.range(1).select(
        hazard.fuzzy_large(F.lit(0.0), 1.125, 2.5).alias("zero"), hazard.fuzzy_large(F.lit(-1.0), 1.125, 2.5).alias("neg"),
        hazard.fuzzy_large(F.lit(None).cast("double"), 1.125, 2.5).alias("none"),
        hazard.hazard_class(F.lit(0.333)).alias("low"), hazard.hazard_class(F.lit(0.3331)).alias("mid"), hazard.hazard_class(F.lit(0.667)).alias("high"),
    ).first()
    assert tuple(row) == (0.0, 0.0, None, 1, 2, 3)


def test_utm_known_point(spark):
    # Central meridian on the equator, and one degree south of it along the meridian.
    x, y = lonlat_to_utm(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(99.0, 0.0), (99.0, -1.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert rows[0].x == pytest.approx(500000.0) and rows[0].y == pytest.approx(10000000.0)
    assert rows[1].y == pytest.approx(10000000.0 - 0.9996 * 110574.3886, abs=0.01)


def box(x, y, w, h):
    x, y, w, h = float(x), float(y), float(w), float(h)
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def test_overlay_special_pairs(spark):
    shapes = {
        1: [[box(0, 0, 10, 10)]],
        2: [[box(0, 0, 10, 10)]],
        3: [[box(2, 2, 3, 3)]],
        4: [[box(10, 0, 5, 10)]],
        5: [[box(0, 0, 10, 10), box(2, 2, 4, 4)]],
        6: [[box(5, -5, 10, 10)]],
        7: [[box(20, 20, 1, 1)]],
        8: [[box(0, 0, 10, 5)]],
        9: [[list(reversed(box(1, 1, 4, 4)))]],
    }
    want = {
        (1, 2): 100, (1, 3): 9, (1, 5): 84, (1, 6): 25, (1, 8): 50, (1, 9): 16, (3, 5): 0, (5, 6): 22, (5, 9): 7, (3, 9): 9, (4, 6): 25, (2, 8): 50,
    }
    make = lambda k: spark.createDataFrame(list(shapes.items()), f"{k} long, coords array<array<array<array<double>>>>")
    a, b = make("a"), make("b")
    pairs = polygon_overlay.bbox_pairs(vector.bounding_box(a, ["a"]), vector.bounding_box(b, ["b"]), "a", "b", 4.0)
    rows = polygon_overlay.intersection_areas(pairs, vector.edges(a, ["a"]), vector.edges(b, ["b"]), "a", "b", 3.0).collect()
    got = {(r.a, r.b): r.area for r in rows}
    for (i, j), area in want.items():
        assert got.get((i, j), 0.0) == pytest.approx(area, abs=1e-9), (i, j)
        assert got.get((j, i), 0.0) == pytest.approx(area, abs=1e-9), (j, i)
    assert (1, 4) not in got and (1, 7) not in got
    assert got[1, 1] == pytest.approx(100) and got[5, 5] == pytest.approx(84)


def test_bbox_pairs_once_each(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, xy), float(xy[0] + s), float(xy[1] + s)) for i, (xy, s) in enumerate(zip(rng.random((60, 2)) * 50, rng.random(60) * 20))]
    cols = "double, ".join(["xmin ", "ymin ", "xmax ", "ymax "]) + "double"
    a = spark.createDataFrame(rows, f"a int, {cols}")
    b = spark.createDataFrame(rows, f"b int, {cols}")
    got = sorted((r.a, r.b) for r in polygon_overlay.bbox_pairs(a, b, "a", "b", 3.0).collect())
    want = sorted(
        (p[0], q[0]) for p in rows for q in rows if max(p[1], q[1]) <= min(p[3], q[3]) and max(p[2], q[2]) <= min(p[4], q[4])
    )
    assert got == want


def test_rasterised_triangle_matches_parity(spark):
    tri = spark.createDataFrame([(1, [[[[0.7, 0.4], [9.3, 3.1], [2.2, 8.8], [0.7, 0.4]]]])], "k int, coords array<array<array<array<double>>>>")
    got = {(r.row, r.col) for r in vector.rasterize_polygons(vector.edges(tri, ["k"]), Grid(10, 10), ["k"]).collect()}
    p = [(0.7, 0.4), (9.3, 3.1), (2.2, 8.8)]
    side = lambda a, b, x, y: (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
    want = {(r, c) for r in range(10) for c in range(10) if all(side(p[i], p[(i + 1) % 3], c + 0.5, r + 0.5) > 0 for i in range(3))}
    assert got == want


@pytest.mark.parametrize("finest", [0.5, 50.0])
def test_nearest_neighbours(spark, finest):
    rng = np.random.default_rng(3)
    pts = [(i, int(i % 2), "PRE" if rng.random() < 0.5 else "POST", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 30, (300, 2)))]
    pts += [(1000 + i, 1, "PRE", 500.0, 500.0) for i in range(50)]
    df = spark.createDataFrame(pts, "point_id long, beam int, date string, x double, y double")
    got = {r.point_id: r.dist for r in altimetry.nearest_distances(df, "beam", finest).collect()}
    want = {p[0]: min(np.hypot(p[3] - q[3], p[4] - q[4]) for q in pts if q[1] == p[1] and q[2] != p[2]) for p in pts}
    assert got == pytest.approx(want)


def test_exit_clusters(spark):
    rng = np.random.default_rng(4)
    xy = rng.random((250, 2)) * 40
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    got = {r.point_id: r.label for r in hydro.exit_clusters(df, 2.0).collect()}
    label = list(range(250))
    changed = True
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= 2.0
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(250)]
        changed, label = new != label, new
    assert got == dict(enumerate(label))
