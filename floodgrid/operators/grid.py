"""Cell tables: cleaning, statistics, alignment, tiling, mosaics and overviews.

A raster is a DataFrame ``(row INT, col INT, value DOUBLE)``; a missing cell is an absent row or
NULL, never NaN. Its geometry is a :class:`Grid`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgrid.functions.quantiles import group_stats


@dataclass(frozen=True)
class Grid:
    """Affine north-aligned grid; ``res_y`` is signed, so north-up rasters have it negative."""

    width: int
    height: int
    origin_x: float = 0.0
    origin_y: float = 0.0
    res_x: float = 1.0
    res_y: float = 1.0
    crs: str = "EPSG:32747"
    nodata: float = -9999.0

    @property
    def cell_area(self) -> float:
        return abs(self.res_x * self.res_y)


def cell_id(grid: Grid, row: str = "row", col: str = "col") -> Column:
    return F.col(row).cast("long") * grid.width + F.col(col)


def cell_xy(grid: Grid) -> tuple[Column, Column]:
    """Map coordinates of the cell centre."""
    x = F.lit(grid.origin_x) + (F.col("col") + 0.5) * grid.res_x
    y = F.lit(grid.origin_y) + (F.col("row") + 0.5) * grid.res_y
    return x, y


def valid_cells(cells: DataFrame, nodata: float = -9999.0, value: str = "value") -> DataFrame:
    """Drop nodata and non-finite cells (nodata within the usual relative/absolute closeness)."""
    v = F.col(value)
    close = F.abs(v - nodata) <= 1e-8 + 1e-5 * abs(nodata)
    return cells.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & ~close)


def clean_range(
    cells: DataFrame, low: float, high: float, nodata: float = -9999.0, value: str = "value"
) -> DataFrame:
    """Values that are nodata or outside [low, high] become NULL; the cell stays."""
    v = F.col(value)
    keep = ~F.isnan(v) & (v != nodata) & (v >= low) & (v <= high)
    return cells.withColumn(value, F.when(keep, v))


def cleaning_report(cells: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return cells.agg(
        F.count("*").alias("total_cells"),
        F.count(v).alias("valid_cells"),
        F.count_if(v.isNull()).alias("invalid_cells"),
    )


def profile(cells: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return group_stats(
        cells,
        [],
        v,
        {"p01": 0.01, "median": 0.5, "p99": 0.99},
        {
            "cells": F.count(v),
            "min_value": F.min(v),
            "mean_value": F.avg(v),
            "max_value": F.max(v),
        },
    )


def top_values(cells: DataFrame, n: int = 10, value: str = "value") -> DataFrame:
    """The n most frequent values."""
    return (
        cells.groupBy(value)
        .agg(F.count("*").alias("cells"))
        .orderBy(F.desc("cells"), F.asc(value))
        .limit(n)
    )


GEOMETRY_FIELDS = ("crs", "width", "height", "res_x", "res_y", "origin_x", "origin_y")


def alignment_report(metadata: DataFrame) -> DataFrame:
    """Which geometry fields differ between the rasters of a metadata table."""
    agreed = [(F.count_distinct(F.col(f)) == 1).alias(f"same_{f}") for f in GEOMETRY_FIELDS]
    out = metadata.agg(F.count("*").alias("rasters"), *agreed)
    return out.withColumn("aligned", reduce(Column.__and__, [F.col(f"same_{f}") for f in GEOMETRY_FIELDS]))


def assert_aligned(metadata: DataFrame) -> None:
    report = alignment_report(metadata).first()
    if not report["aligned"]:
        bad = [f for f in GEOMETRY_FIELDS if not report[f"same_{f}"]]
        raise ValueError("rasters are not aligned: " + ", ".join(bad))


def snap_extent(
    boxes: DataFrame, res: float, origin_x: float = 0.0, origin_y: float = 0.0
) -> DataFrame:
    """Grow the extent of all boxes outwards to grid lines about an origin."""

    def snapped(agg: Column, origin: float, rounding) -> Column:
        return rounding((agg - origin) / res) * res + origin

    ext = boxes.agg(
        snapped(F.min("xmin"), origin_x, F.floor).alias("xmin"),
        snapped(F.min("ymin"), origin_y, F.floor).alias("ymin"),
        snapped(F.max("xmax"), origin_x, F.ceil).alias("xmax"),
        snapped(F.max("ymax"), origin_y, F.ceil).alias("ymax"),
    )
    return ext.withColumn(
        "width", F.round((F.col("xmax") - F.col("xmin")) / res).cast("long")
    ).withColumn("height", F.round((F.col("ymax") - F.col("ymin")) / res).cast("long"))


def tile_plan(sizes: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Fixed-size tiles over each ``(width, height)`` row; edge tiles are partial."""
    row0 = F.explode(F.expr(f"sequence(0L, height - 1, {tile_h}L)")).alias("row0")
    col0 = F.explode(F.expr(f"sequence(0L, width - 1, {tile_w}L)")).alias("col0")
    keep = [c for c in sizes.columns]
    out = sizes.where("width > 0 and height > 0").select(*keep, row0).select(*keep, "row0", col0)
    return out.select(
        *[c for c in keep if c not in ("width", "height")],
        F.expr(f"row0 div {tile_h}").alias("tile_row"),
        F.expr(f"col0 div {tile_w}").alias("tile_col"),
        "row0",
        "col0",
        F.least(F.lit(tile_w), F.col("width") - F.col("col0")).alias("tile_width"),
        F.least(F.lit(tile_h), F.col("height") - F.col("row0")).alias("tile_height"),
    )


def split_bbox(boxes: DataFrame, cols: int, rows: int) -> DataFrame:
    """Each box cut into ``cols`` x ``rows`` equal parts, numbered from the lower left."""
    keep = [c for c in boxes.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    w = (F.col("xmax") - F.col("xmin")) / cols
    h = (F.col("ymax") - F.col("ymin")) / rows
    out = boxes.withColumn("part_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    out = out.withColumn("part_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return out.select(
        *keep,
        "part_row",
        "part_col",
        (F.col("xmin") + w * F.col("part_col")).alias("xmin"),
        (F.col("ymin") + h * F.col("part_row")).alias("ymin"),
        (F.col("xmin") + w * (F.col("part_col") + 1)).alias("xmax"),
        (F.col("ymin") + h * (F.col("part_row") + 1)).alias("ymax"),
    )


def mosaic(tiles: DataFrame, order: str = "source", value: str = "value") -> DataFrame:
    """Overlapping tile cells to one raster; the first source with data wins."""
    return (
        tiles.where(F.col(value).isNotNull())
        .groupBy("row", "col")
        .agg(F.min_by(F.col(value), F.col(order)).alias(value), F.min(order).alias(order))
    )


def overview(cells: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Average of the valid cells of each factor x factor block."""
    return (
        cells.where(F.col(value).isNotNull())
        .groupBy(
            F.expr(f"cast(floor(row / {factor}) as int)").alias("row"),
            F.expr(f"cast(floor(col / {factor}) as int)").alias("col"),
        )
        .agg(F.avg(value).alias(value))
    )


def overview_factors(width: int, height: int, smallest: int = 256) -> list[int]:
    """Doubling factors 2..64 while both reduced sides keep ``smallest`` pixels."""
    return [f for f in (2, 4, 8, 16, 32, 64) if min(width, height) // f >= smallest]


def overview_pyramid(cells: DataFrame, factors: list[int], value: str = "value") -> DataFrame:
    """All levels in one pass: each cell is added to its block on every level."""
    level = F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor")
    return (
        cells.where(F.col(value).isNotNull())
        .select("row", "col", value, level)
        .groupBy(
            "factor",
            F.expr("cast(floor(row / factor) as int)").alias("row"),
            F.expr("cast(floor(col / factor) as int)").alias("col"),
        )
        .agg(F.avg(value).alias(value))
    )


def crop_window(cells: DataFrame) -> DataFrame:
    """Smallest window holding all cells."""
    return cells.agg(
        F.min("row").alias("row_min"),
        F.max("row").alias("row_max"),
        F.min("col").alias("col_min"),
        F.max("col").alias("col_max"),
        F.count("*").alias("cells"),
    )


def clip_to_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")


def from_rows(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of a grid, generated on the executors."""
    return spark.range(grid.width * grid.height).select(
        F.expr(f"cast(id div {grid.width} as int)").alias("row"),
        F.expr(f"cast(id % {grid.width} as int)").alias("col"),
    )
