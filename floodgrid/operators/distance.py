"""Exact Euclidean distance to the nearest mask cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.operators.focal import dilate
from floodgrid.operators.grid import Grid, from_rows
from floodgrid.runtime import materialize

# Cells of a strip: a task's arrays, whatever the width of the grid (a strip is one row at least).
_STRIP_CELLS = 1 << 18
_BLOCK = 4096


def _nearest(gap: np.ndarray, cols: np.ndarray, at: np.ndarray, dx: float) -> tuple[np.ndarray, np.ndarray]:
    """min over j of gap[:, j]^2 + (dx (at[i] - cols[j]))^2 for every row and ascending position, and its first j.

    The best j never moves left as the position grows, so positions are solved coarse to fine and
    each searches only between the answers of its neighbours: O(n log n) per row.
    """
    rows, count = gap.shape[0], len(at)
    g2 = gap**2
    best = np.full((rows, count), np.inf)
    arg = np.zeros((rows, count + 2), dtype="int64")  # guards at both ends
    arg[:, -1] = len(cols) - 1
    step = 1 << max(count - 1, 1).bit_length()
    while step >= 1:
        pos = np.arange(step - 1, count, 2 * step)
        if len(pos):
            left = np.maximum(pos - step, -1) + 1
            right = np.minimum(pos + step, count) + 1
            lo, hi = arg[:, left].ravel(), arg[:, right].ravel()
            size = hi - lo + 1
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            seg = np.repeat(np.arange(len(size)), size)
            j = np.arange(len(seg)) - start[seg] + lo[seg]
            r, p = seg // len(pos), at[pos[seg % len(pos)]]
            cost = g2[r, j] + (dx * (p - cols[j])) ** 2
            low = np.minimum.reduceat(cost, start)
            hit = np.flatnonzero(cost == low[seg])
            _, first = np.unique(seg[hit], return_index=True)
            best[:, pos] = low.reshape(rows, -1)
            arg[:, pos + 1] = j[hit[first]].reshape(rows, -1)
        step //= 2
    return best, arg[:, 1:-1]


def _gap_matrix(pdf: pd.DataFrame, dy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and their gaps in map units, infinite where the frame has no cell."""
    rows, r = np.unique(pdf["row"].to_numpy(), return_inverse=True)
    cols, c = np.unique(pdf["col"].to_numpy(), return_inverse=True)
    gap = np.full((len(rows), len(cols)), np.inf)
    gap[r, c] = pdf["gap"].to_numpy() * dy
    return rows, cols, gap


def _row_envelopes(gaps: DataFrame, grid: Grid, keys: list[str], fields: list[str], block: int) -> DataFrame:
    """(keys, row, col, dist) from the gaps of each column, for rows of any length: no task holds a row.

    Every block of columns answers the borders of all blocks. The best column of a row never moves left
    from border to border, so the cells of a block need only the columns between the answers at its two
    borders: a column goes to one block, or to all blocks whose border it wins. Long stretches of
    such columns are looked at block by block and the least is kept.
    """
    dx, dy, width = abs(grid.res_x), abs(grid.res_y), grid.width
    last = (width - 1) // block
    borders = np.minimum(np.arange(last + 2) * block, width - 1)
    cells = materialize(gaps.withColumn("src", F.floor(F.col("col") / block).cast("int")))

    def keyed(out: pd.DataFrame, pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *names]]

    def at_borders(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, gap = _gap_matrix(pdf, dy)
        sq, j = _nearest(gap, cols, borders, dx)
        n = len(borders)
        out = {"row": np.repeat(rows, n), "p": np.tile(np.arange(n), len(rows)), "sq": sq.ravel(), "best": cols[j].ravel()}
        return keyed(pd.DataFrame(out), pdf, ["row", "p", "sq", "best"])

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, gap = _gap_matrix(pdf, dy)
        first = int(pdf["p"].iloc[0]) * block
        at = np.arange(first, min(first + block, width))
        sq, _ = _nearest(gap, cols, at, dx)
        out = {"row": np.repeat(rows, len(at)), "col": np.tile(at, len(rows)), "sq": sq.ravel()}
        return keyed(pd.DataFrame(out), pdf, ["row", "col", "sq"])

    answers = cells.groupBy(*keys, "strip", "src").applyInPandas(at_borders, ", ".join([*fields, "row int, p int, sq double, best int"]))
    won = answers.groupBy(*keys, "row", "p").agg(F.min(F.struct("sq", "best"))["best"].alias("lo"))
    ahead = Window.partitionBy(*keys, "row").orderBy("p")
    spans = won.withColumn("hi", F.lead("lo").over(ahead)).where("hi is not null")
    of = lambda c: F.floor(F.col(c) / block).cast("int")
    spans = spans.withColumn("src", F.explode(F.sequence(of("lo"), of("hi"))))
    sent = cells.join(spans, [*keys, "row", "src"]).where(F.col("col").between(F.col("lo"), F.col("hi")))
    found = sent.groupBy(*keys, "strip", "p", "src").applyInPandas(in_block, ", ".join([*fields, "row int, col int, sq double"]))
    return found.groupBy(*keys, "row", "col").agg(F.sqrt(F.min("sq")).alias("dist"))


def distance_to(
    mask: DataFrame,
    grid: Grid,
    key: str | None = None,
    key_values: list | None = None,
    block_cols: int = _STRIP_CELLS,
) -> DataFrame:
    """(key?, row, col, dist) for every grid cell; no row where the mask of the key is empty.

    Columns first (nearest mask row above and below, by windows), then rows (lower envelope,
    strips of rows as Arrow batches). A group is a block of one column or a strip of rows, so
    narrow, tall grids are spread as well as square ones. Rows of more than ``block_cols`` columns
    are solved in blocks of columns (``_row_envelopes``), with the same result.
    """
    keys = [key] if key else []
    dx, dy = abs(grid.res_x), abs(grid.res_y)
    spark = mask.sparkSession
    strip = max(1, min(32, _STRIP_CELLS // max(min(grid.width, block_cols), 1)))
    base = from_rows(spark, grid)
    if key:
        kind = mask.schema[key].dataType
        base = base.withColumn(key, F.explode(F.array(*[F.lit(k).cast(kind) for k in key_values])))
    both = base.select(*keys, "row", "col", F.lit(None).cast("int").alias("m")).unionByName(
        mask.select(*keys, "row", "col", F.col("row").alias("m"))
    )
    block = F.floor(F.col("row") / _BLOCK).cast("int")
    both = both.withColumn("_blk", block)
    at = [*keys, "col", "_blk"]
    up = Window.partitionBy(*at).orderBy("row").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*at).orderBy(F.desc("row")).rangeBetween(Window.unboundedPreceding, 0)
    # What lies above and below each block of a column, from one row per block.
    inside = mask.select(*keys, "col", block.alias("_blk"), "row").groupBy(*at).agg(
        F.min("row").alias("_f"), F.max("row").alias("_l")
    )
    blocks = base.where(F.col("row") % _BLOCK == 0).select(*keys, "col", block.alias("_blk")).join(inside, at, "left")
    order = Window.partitionBy(*keys, "col").orderBy("_blk")
    back = Window.partitionBy(*keys, "col").orderBy(F.desc("_blk"))
    so_far = Window.unboundedPreceding
    carried = blocks.select(
        *at,
        F.max("_l").over(order.rowsBetween(so_far, -1)).alias("_above"),
        F.min("_f").over(back.rowsBetween(so_far, -1)).alias("_below"),
    )
    gaps = (
        both.withColumn("_a", F.max("m").over(up))
        .withColumn("_b", F.min("m").over(down))
        .where("m is null")
        .join(carried, at)
        .withColumn("_a", F.coalesce("_a", "_above"))
        .withColumn("_b", F.coalesce("_b", "_below"))
        .select(
            *keys,
            "row",
            "col",
            F.least(F.col("row") - F.col("_a"), F.col("_b") - F.col("row")).alias("gap"),
        )
        .where("gap is not null")
        .withColumn("strip", F.floor(F.col("row") / strip).cast("int"))
    )
    width = grid.width
    fields = [f"{key} {mask.schema[key].dataType.simpleString()}"] if key else []
    if width > block_cols:
        return _row_envelopes(gaps, grid, keys, fields, block_cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, gap = _gap_matrix(pdf, dy)
        at = np.arange(width, dtype="int32")
        sq, _ = _nearest(gap, cols, at, dx)
        out = pd.DataFrame({"row": np.repeat(rows, width).astype("int32"), "col": np.tile(at, len(rows)), "dist": np.sqrt(sq).ravel()})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "row", "col", "dist"]]

    schema = ", ".join([*fields, "row int, col int, dist double"])
    return gaps.groupBy(*keys, "strip").applyInPandas(run, schema)


def distance_inside(mask: DataFrame, grid: Grid, block_cols: int = _STRIP_CELLS) -> DataFrame:
    """For mask cells: distance to the nearest cell outside (the grid border is not outside)."""
    m = mask.select("row", "col").distinct()
    outside = from_rows(mask.sparkSession, grid).join(m, ["row", "col"], "left_anti")
    return distance_to(outside, grid, block_cols=block_cols).join(m, ["row", "col"], "left_semi")


def _row_gaps(queries: DataFrame, targets: DataFrame, rows: int, cols: int, keys: list[str]) -> DataFrame:
    """(keys, row, col, d, gap): nearest target within ``cols`` columns, in each of the rows up to ``rows`` away.

    Each query looks along the rows around it, which sorted windows over blocks of a row answer. A
    target is copied only to the next blocks that its reach touches.
    """
    block = lambda c: F.floor(c / _BLOCK).cast("int")
    off = F.explode(F.sequence(F.lit(-rows), F.lit(rows))).alias("_d")
    looks = queries.select(*keys, "row", "col", off).select(
        *keys, (F.col("row") + F.col("_d")).alias("_line"), block(F.col("col")).alias("_blk"), "col", "_d", F.lit(None).cast("int").alias("_t")
    )
    spread = F.explode(F.sequence(block(F.col("col") - cols), block(F.col("col") + cols))).alias("_blk")
    marks = targets.select(*keys, F.col("row").alias("_line"), spread, "col", F.lit(None).cast("int").alias("_d"), F.col("col").alias("_t"))
    line = Window.partitionBy(*keys, "_line", "_blk")
    near = line.orderBy("col").rangeBetween(-cols, 0)
    far = line.orderBy("col").rangeBetween(0, cols)
    both = looks.unionByName(marks).withColumn("_a", F.max("_t").over(near)).withColumn("_b", F.min("_t").over(far))
    gap = F.least(F.col("col") - F.col("_a"), F.col("_b") - F.col("col"))
    hit = both.where("_d is not null").withColumn("gap", gap).where("gap is not null")
    return hit.select(*keys, (F.col("_line") - F.col("_d")).alias("row"), "col", F.col("_d").alias("d"), "gap")


def distance_within(queries: DataFrame, targets: DataFrame, grid: Grid, reach: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, row, col, dist): Euclidean distance from each query cell to the nearest target of its key.

    Only distances up to ``reach`` map units; no row beyond it. The work follows the query cells, not
    the grid.
    """
    keys = keys or []
    dx, dy = abs(grid.res_x), abs(grid.res_y)
    asked = queries.select(*keys, "row", "col").distinct()
    hits = _row_gaps(asked, targets.select(*keys, "row", "col"), int(reach / dy), int(reach / dx), keys)
    near = hits.groupBy(*keys, "row", "col").agg(F.min(F.hypot(F.col("d") * dy, F.col("gap") * dx)).alias("dist"))
    return near.where(F.col("dist") <= reach)


def buffer_cells(mask: DataFrame, grid: Grid, distance: float) -> DataFrame:
    """(row, col) of the grid's cells whose centre is within ``distance`` map units of a cell of ``mask``.

    Only the rim of the mask looks outward; all cells inside are taken as they are.
    """
    m = mask.select("row", "col").distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    sides = m.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(steps).alias("s"))
    outer = sides.select("_r", "_c", (F.col("_r") + F.col("s.i")).alias("row"), (F.col("_c") + F.col("s.j")).alias("col")).join(m, ["row", "col"], "left_anti")
    rim = outer.select(F.col("_r").alias("row"), F.col("_c").alias("col")).distinct()
    pixels = max(int(distance / abs(grid.res_y)), int(distance / abs(grid.res_x)))
    around = dilate(rim, pixels, grid).join(m, ["row", "col"], "left_anti")
    return distance_within(around, rim, grid, distance).select("row", "col").unionByName(m)


def inside_within(cells: DataFrame, mask: DataFrame, grid: Grid, reach: float) -> DataFrame:
    """``distance_within`` from cells of ``mask`` to the nearest grid cell outside it (the grid border is not outside).

    The nearest outside cell always touches the mask, so only the rim of the mask is a target.
    """
    m = mask.select("row", "col").distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rim = m.select("row", "col", F.explode(steps).alias("s")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    rim = rim.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).distinct()
    asked = cells.select("row", "col").join(m, ["row", "col"], "left_semi")
    return distance_within(asked, rim.join(m, ["row", "col"], "left_anti"), grid, reach)


def square_reach(queries: DataFrame, targets: DataFrame, reach: int, keys: list[str] | None = None) -> DataFrame:
    """Query rows with ``steps``: the smallest square radius, up to ``reach``, that meets a target.

    No row where none is near.
    """
    keys = keys or []
    hits = _row_gaps(queries, targets, reach, reach, keys)
    return hits.groupBy(*keys, "row", "col").agg(F.min(F.greatest(F.abs("d"), F.col("gap"))).alias("steps"))
