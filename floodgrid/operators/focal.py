"""3x3 neighbourhood operators: slope, hillshade, median; square dilation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.functions.quantiles import group_percentiles
from floodgrid.operators.grid import Grid

# Cells per window along a row or column; longer lines are cut and share two cells at each cut.
BLOCK = 4096
# Side of the tiles of the median.
TILE = 256


def _with_halo(df: DataFrame, axis: str) -> DataFrame:
    """Adds ``_blk`` along an axis; the two cells at a cut also appear next door (not ``_own``)."""
    b, k = F.floor(F.col(axis) / BLOCK), F.pmod(axis, F.lit(BLOCK))
    near = F.array_compact(
        F.array(
            F.struct(b.alias("_blk"), F.lit(True).alias("_own")),
            F.when(k < 2, F.struct((b - 1).alias("_blk"), F.lit(False).alias("_own"))),
            F.when(k >= BLOCK - 2, F.struct((b + 1).alias("_blk"), F.lit(False).alias("_own"))),
        )
    )
    return df.select("*", F.inline(near))


def neighbourhood(cells: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``nb``: the nine values around each cell, row by row, NULL where absent.

    Two sorted passes (along rows, then along columns) instead of nine emitted copies of the
    raster. A row pass also leaves the triple of an absent cell next to a present one, so that
    diagonal neighbours across a gap are not lost. ``keys`` separate several layers of cells.
    """
    keep = [c for c in cells.columns if c not in ("row", "col", *keys)]
    along = Window.partitionBy(*keys, "row", "_blk").orderBy("col")
    v = F.col(value)
    h = (
        _with_halo(cells, "col").withColumn("_pc", F.lag("col").over(along))
        .withColumn("_pv", F.lag(value).over(along))
        .withColumn("_nc", F.lead("col").over(along))
        .withColumn("_nv", F.lead(value).over(along))
        .where("_own")
    )
    none = F.lit(None).cast("double")
    left = F.when(F.col("_pc") == F.col("col") - 1, F.col("_pv"))
    right = F.when(F.col("_nc") == F.col("col") + 1, F.col("_nv"))
    payload = F.struct(*keep)

    def entry(col: Column, a: Column, b: Column, c: Column, body: Column) -> Column:
        triple = F.array(a.cast("double"), b.cast("double"), c.cast("double"))
        return F.struct(col.alias("col"), triple.alias("t"), body.alias("p"))

    absent = F.when(F.lit(False), payload)
    here = entry(F.col("col"), left, v, right, payload)
    gap_after = F.col("_nc").isNull() | (F.col("_nc") > F.col("col") + 1)
    after = F.when(
        gap_after,
        entry(F.col("col") + 1, v, none, F.when(F.col("_nc") == F.col("col") + 2, F.col("_nv")), absent),
    )
    gap_before = F.col("_pc").isNull() | (F.col("_pc") < F.col("col") - 2)
    before = F.when(gap_before, entry(F.col("col") - 1, none, none, v, absent))
    rows = h.select(
        *keys, "row", F.inline(F.filter(F.array(here, after, before), lambda e: e.isNotNull()))
    )
    rows = _with_halo(rows, "row")
    down = Window.partitionBy(*keys, "col", "_blk").orderBy("row")
    empty = F.array(none, none, none)

    def neighbour_row(shift, delta: int) -> Column:
        hit = shift("row").over(down) == F.col("row") + delta
        return F.coalesce(F.when(hit, shift("t").over(down)), empty)

    full = rows.withColumn("_up", neighbour_row(F.lag, -1)).withColumn(
        "_dn", neighbour_row(F.lead, 1)
    )
    return full.where(F.col("_own") & F.col("p").isNotNull()).select(
        *keys, "row", "col", "p.*", F.concat("_up", "t", "_dn").alias("nb")
    )


def nb(dr: int, dc: int) -> Column:
    return F.col("nb")[(dr + 1) * 3 + dc + 1]


def _padded(grid: Grid, fill: Column):
    """Neighbour access with edge replication at the grid border and filled gaps."""

    def at(dr: int, dc: int) -> Column:
        r = F.lit(dr)
        c = F.lit(dc)
        if dr:
            edge = F.col("row") == (0 if dr < 0 else grid.height - 1)
            r = F.when(edge, 0).otherwise(dr)
        if dc:
            edge = F.col("col") == (0 if dc < 0 else grid.width - 1)
            c = F.when(edge, 0).otherwise(dc)
        return F.coalesce(F.get("nb", (r + 1) * 3 + c + 1), fill)

    return at


def median_value(cells: DataFrame, value: str = "value") -> Column:
    """Exact raster median as a one-row scalar subquery."""
    return group_percentiles(cells, [], value, {"m": 0.5}).scalar()


def gap_value(valid: DataFrame, grid: Grid, value: str) -> Column:
    """What stands for missing cells: the raster median, which is only made if a cell of the grid is missing."""
    if valid.count() == grid.width * grid.height:
        return F.lit(None).cast("double")
    return median_value(valid, value)


def horn_slope(cells: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """Slope in degrees; gaps take the raster median, the border is replicated."""
    z = _padded(grid, F.col("_fill"))
    dx, dy = abs(grid.res_x), abs(grid.res_y)
    east = z(-1, 1) + 2 * z(0, 1) + z(1, 1)
    west = z(-1, -1) + 2 * z(0, -1) + z(1, -1)
    south = z(1, -1) + 2 * z(1, 0) + z(1, 1)
    north = z(-1, -1) + 2 * z(-1, 0) + z(-1, 1)
    valid = cells.where(F.col(value).isNotNull())
    around = neighbourhood(valid, value).withColumn("_fill", gap_value(valid, grid, value))
    rise = F.hypot((east - west) / (8.0 * dx), (south - north) / (8.0 * dy))
    return around.withColumn("slope_deg", F.degrees(F.atan(rise))).drop("nb", "_fill")


def hillshade(
    cells: DataFrame,
    grid: Grid,
    value: str = "value",
    azimuth: float = 315.0,
    altitude: float = 45.0,
) -> DataFrame:
    """Shaded relief 0..255 from central differences, one-sided at the grid border."""
    fill = F.col("_fill")

    def gradient(axis: str, size: int, res: float) -> Column:
        def at(k: int) -> Column:
            return F.coalesce(nb(k, 0) if axis == "row" else nb(0, k), fill)

        pos = F.col(axis)
        return (
            F.when(pos == 0, (at(1) - at(0)) / res)
            .when(pos == size - 1, (at(0) - at(-1)) / res)
            .otherwise((at(1) - at(-1)) / (2.0 * res))
        )

    valid = cells.where(F.col(value).isNotNull())
    g = (
        neighbourhood(valid, value)
        .withColumn("_fill", gap_value(valid, grid, value))
        .withColumn("_dzdy", gradient("row", grid.height, abs(grid.res_y)))
        .withColumn("_dzdx", gradient("col", grid.width, abs(grid.res_x)))
    )
    az, alt = math.radians(azimuth), math.radians(altitude)
    slope = F.atan(F.hypot("_dzdx", "_dzdy"))
    aspect = F.atan2(-F.col("_dzdx"), F.col("_dzdy"))
    light = math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    scaled = F.least(F.greatest((light + 1.0) / 2.0 * 255.0, F.lit(0.0)), F.lit(255.0))
    return g.withColumn("shade", F.floor(scaled).cast("int")).drop("nb", "_fill", "_dzdy", "_dzdx")


def _median_tile(fields: list[str], names: list[str], own: str, tile: int):
    """Medians around the wanted cells of one tile, from its cells and those just beyond its border."""
    side = tile + 2

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # The tile's place stands last in the key.
        r0, c0 = int(key[-2]) * tile - 1, int(key[-1]) * tile - 1
        at = (pdf["row"].to_numpy("int64") - r0) * side + pdf["col"].to_numpy("int64") - c0
        has = pdf["has"].to_numpy("int64")
        asked = np.unique(at[pdf["want"].to_numpy(bool)])
        around = asked[:, None] + np.array([i * side + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
        line, some = np.arange(len(asked)), np.zeros(len(asked), bool)
        found = {}
        for k, name in enumerate(names):
            values, present = np.full(side * side, np.nan), np.zeros(side * side, bool)
            here = (has >> k) & 1 == 1
            values[at[here]], present[at[here]] = pdf[f"_v{k}"].to_numpy("float64")[here], True
            n = present[around].sum(axis=1)
            # Missing cells come last, as NaN does; without any cell the median is missing.
            ranked = np.sort(values[around], axis=1)
            found[name] = (ranked[line, (n - 1) // 2] + ranked[line, n // 2]) / 2
            if own:
                found[own + name] = values[asked]
            some |= n > 0
        asked, found = asked[some], {name: v[some] for name, v in found.items()}
        out = {f: pd.Series([k] * len(asked), dtype=object) for f, k in zip(fields, key)}
        return pd.DataFrame({**out, "row": asked // side + r0, "col": asked % side + c0, **found})

    return run


def median3(
    cells: DataFrame, domain: DataFrame, value: str | list[str] = "value", keys: tuple[str, ...] = (), tile: int = TILE, own: str = ""
) -> DataFrame:
    """3x3 median of the present values for every domain cell; gaps in the domain get filled.

    With ``keys`` the domain carries them too: one domain per layer. Tiles get the cells just beyond their border
    too, so cells and domain are shuffled once. ``value`` may be up to 32 columns, whose medians are NULL where none is
    present; with ``own`` the domain cells' own values come along under names with that prefix.
    """
    names = [value] if isinstance(value, str) else list(value)

    def tiles(axis: str) -> Column:
        own, k = F.floor(F.col(axis) / tile).cast("int"), F.pmod(axis, F.lit(tile))
        return F.explode(F.array_compact(F.array(own, F.when(k == 0, own - 1), F.when(k == tile - 1, own + 1))))

    here = lambda axis: F.floor(F.col(axis) / tile).cast("int")
    packed = [F.col(n).cast("double").alias(f"_v{k}") for k, n in enumerate(names)]
    has = sum((F.when(F.col(n).isNotNull(), 1 << k).otherwise(0) for k, n in enumerate(names)), F.lit(0).cast("long"))
    present = cells.where(F.coalesce(*names).isNotNull()).select(*keys, "row", "col", *packed, has.alias("has"), F.lit(False).alias("want"))
    present = present.select("*", tiles("row").alias("trow")).select("*", tiles("col").alias("tcol"))
    none = [F.lit(None).cast("double").alias(f"_v{k}") for k in range(len(names))]
    asked = domain.select(*keys, "row", "col", *none, F.lit(0).cast("long").alias("has"), F.lit(True).alias("want"), here("row").alias("trow"), here("col").alias("tcol"))
    both = present.unionByName(asked)
    key_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema] if keys else []
    made = [f"`{p}{n}` double" for n in names for p in ([own, ""] if own else [""])]
    schema = ", ".join([*key_fields, "row int, col int", *made])
    return both.groupBy(*keys, "trow", "tcol").applyInPandas(_median_tile(list(keys), names, own, tile), schema)


def dilate(mask: DataFrame, radius: int | Column, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """Square dilation by ``radius`` cells, clipped to the grid.

    Rows first, then columns, with duplicates removed in between: 2(2r+1) copies, not (2r+1)^2.
    """
    keys = keys or []
    r = F.lit(radius) if isinstance(radius, int) else radius
    reach = F.sequence(-r, r)
    rows = mask.select(
        *keys, "col", r.alias("_r"), F.explode(F.transform(reach, lambda d: F.col("row") + d)).alias("row")
    ).where(F.col("row").between(0, grid.height - 1))
    rows = rows.distinct()
    back = F.sequence(-F.col("_r"), F.col("_r"))
    both = rows.select(
        *keys, "row", F.explode(F.transform(back, lambda d: F.col("col") + d)).alias("col")
    ).where(F.col("col").between(0, grid.width - 1))
    return both.distinct()
