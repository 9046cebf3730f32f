"""The 3x3 median over tiles of any size against plain Python."""

import statistics

import pytest

from floodgrid.operators.focal import median3


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_median_over_tile_borders(spark, tile):
    cells = {(k, r, c): float((7 * r + 3 * c + 5 * ord(k)) % 11) for k in "ab" for r in range(-3, 6) for c in range(5) if (r + 2 * c) % 4}
    domain = [(k, r, c) for k in "ab" for r in range(-3, 7) for c in range(-1, 6) if k == "a" or c < 3]
    rows = [(*p, v) for p, v in cells.items()] + [("a", 0, 0, None)]
    df = spark.createDataFrame(rows, "k string, row int, col int, v double")
    out = median3(df, spark.createDataFrame(domain + domain[:3], "k string, row int, col int"), "v", ("k",), tile)
    want = {}
    for k, r, c in domain:
        near = [cells[k, r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (k, r + i, c + j) in cells]
        if near:
            want[k, r, c] = statistics.median(near)
    got = out.collect()
    assert len(got) == len(want) and {(x.k, x.row, x.col): x.v for x in got} == want


def test_median_shuffles_once(spark):
    df = spark.range(100).selectExpr("cast(id / 10 as int) row", "cast(id % 10 as int) col", "double(id) value")
    plan = median3(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
