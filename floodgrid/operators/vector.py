"""Vector features as edge tables: edges, measures, rasterising polygons and lines.

``coords`` is ``ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>``: part, ring (or path), vertex, (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.operators.grid import Grid


def edges(features: DataFrame, keys: list[str], coords: str = "coords") -> DataFrame:
    """(keys, part, ring, seq, x1, y1, x2, y2) for every pair of successive vertices."""
    parts = features.select(*keys, F.posexplode(coords).alias("part", "_p"))
    rings = parts.select(*keys, "part", F.posexplode("_p").alias("ring", "_r"))
    pairs = F.expr(
        """transform(sequence(1, size(_r) - 1), i -> named_struct(
             'seq', i - 1,
             'x1', _r[i - 1][0], 'y1', _r[i - 1][1], 'x2', _r[i][0], 'y2', _r[i][1]))"""
    )
    return rings.where(F.size("_r") > 1).select(*keys, "part", "ring", F.inline(pairs))


def vertices(features: DataFrame, keys: list[str], coords: str = "coords") -> DataFrame:
    flat = F.flatten(F.flatten(coords))
    return features.select(*keys, F.posexplode(flat).alias("seq", "_v")).select(
        *keys, "seq", F.col("_v")[0].alias("x"), F.col("_v")[1].alias("y")
    )


def bounding_box(features: DataFrame, keys: list[str], coords: str = "coords") -> DataFrame:
    """Box per feature without exploding: min and max over the nested vertex list."""
    flat = F.flatten(F.flatten(coords))
    xs, ys = F.transform(flat, lambda v: v[0]), F.transform(flat, lambda v: v[1])
    return features.select(
        *keys,
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def line_length(edge_table: DataFrame, keys: list[str]) -> DataFrame:
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    g = edge_table.groupBy(*keys) if keys else edge_table
    return g.agg(F.sum(size).alias("length"))


def ring_areas(edge_table: DataFrame, keys: list[str]) -> DataFrame:
    """Signed area per ring (shoelace)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edge_table.groupBy(*keys, "part", "ring").agg((F.sum(cross) / 2).alias("signed_area"))


def _in_cells(edge_table: DataFrame, grid: Grid) -> DataFrame:
    u = lambda x: (F.col(x) - grid.origin_x) / grid.res_x
    v = lambda y: (F.col(y) - grid.origin_y) / grid.res_y
    return edge_table.withColumns({"u1": u("x1"), "v1": v("y1"), "u2": u("x2"), "v2": v("y2")})


def _count_range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high))


def rasterize_polygons(edge_table: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, row, col) of the cells whose centre lies inside; holes and parts by parity.

    Scan lines: each edge gives its crossings with the row centres it spans (half-open, so a
    shared vertex counts once), crossings of one feature and row are paired in order, and each
    pair yields a run of columns. No join with the cells, and no feature is ever one group.
    """
    e = _in_cells(edge_table, grid).where("v1 != v2")
    first = F.greatest(F.ceil(F.least("v1", "v2") - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.greatest("v1", "v2") - 0.5) - 1, F.lit(grid.height - 1)).cast("int")
    hits = e.select(*keys, "u1", "v1", "u2", "v2", F.explode(_count_range(first, last)).alias("row"))
    at = F.col("row") + 0.5
    u = F.col("u1") + (at - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    line = Window.partitionBy(*keys, "row").orderBy("u")
    spans = (
        hits.select(*keys, "row", u.alias("u"))
        .withColumn("_k", F.row_number().over(line))
        .withColumn("_end", F.lead("u").over(line))
        .where("_k % 2 = 1")
    )
    c0 = F.greatest(F.ceil(F.col("u") - 0.5), F.lit(0)).cast("int")
    c1 = F.least(F.ceil(F.col("_end") - 0.5) - 1, F.lit(grid.width - 1)).cast("int")
    return spans.select(*keys, "row", F.explode(_count_range(c0, c1)).alias("col"))


def rasterize_lines(edge_table: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, row, col) of every cell a segment touches."""
    e = _in_cells(edge_table, grid)
    lo_u, hi_u = F.least("u1", "u2"), F.greatest("u1", "u2")
    c0 = F.greatest(F.floor(lo_u), F.lit(0)).cast("int")
    c1 = F.least(F.floor(hi_u), F.lit(grid.width - 1)).cast("int")
    strips = e.select(*keys, "u1", "v1", "u2", "v2", F.explode(_count_range(c0, c1)).alias("col"))

    def v_at(u: Column) -> Column:
        run = F.col("u2") - F.col("u1")
        t = F.when(run == 0, None).otherwise((u - F.col("u1")) / run)
        return F.col("v1") + t * (F.col("v2") - F.col("v1"))

    ua = F.greatest(F.col("col").cast("double"), F.least("u1", "u2"))
    ub = F.least(F.col("col") + 1.0, F.greatest("u1", "u2"))
    va = F.coalesce(v_at(ua), F.col("v1"))
    vb = F.coalesce(v_at(ub), F.col("v2"))
    r0 = F.greatest(F.floor(F.least(va, vb)), F.lit(0)).cast("int")
    r1 = F.least(F.floor(F.greatest(va, vb)), F.lit(grid.height - 1)).cast("int")
    return strips.select(*keys, F.explode(_count_range(r0, r1)).alias("row"), "col").distinct()


def tiles_meeting(tiles: DataFrame, edge_table: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """(tile_row, tile_col, keys): square tiles of side ``size`` that polygons meet.

    A tile is met when an edge runs through it or when its centre lies inside. Edges are sent
    only to the tile columns and rows they cross, so this is an equi-join on tile numbers.
    """
    plain = Grid(2**31 - 2, 2**31 - 2, 0.0, 0.0, size, size)
    touched = rasterize_lines(edge_table, plain, keys)
    inside = rasterize_polygons(edge_table, plain, keys)
    both = touched.unionByName(inside).distinct()
    return tiles.join(
        both.select(*keys, F.col("row").alias("tile_row"), F.col("col").alias("tile_col")), ["tile_row", "tile_col"]
    )
