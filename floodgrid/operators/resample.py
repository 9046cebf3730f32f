"""Reprojection of rasters onto another grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.operators.grid import Grid, cell_xy, from_rows

Transform = Callable[[Column, Column], tuple[Column, Column]]


def _targets(cells: DataFrame, target: Grid, to_source: Transform | None) -> DataFrame:
    x, y = cell_xy(target)
    t = from_rows(cells.sparkSession, target).select("row", "col", x.alias("x"), y.alias("y"))
    if to_source is None:
        return t
    sx, sy = to_source(F.col("x"), F.col("y"))
    return t.select("row", "col", sx.alias("x"), sy.alias("y"))


def resample_nearest(cells: DataFrame, source: Grid, target: Grid, to_source: Transform | None = None, value: str = "value") -> DataFrame:
    """Value of the source cell that holds each target cell centre."""
    t = _targets(cells, target, to_source)
    r = F.floor((F.col("y") - source.origin_y) / source.res_y).cast("int")
    c = F.floor((F.col("x") - source.origin_x) / source.res_x).cast("int")
    s = cells.where(F.col(value).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return t.withColumn("_r", r).withColumn("_c", c).join(s, ["_r", "_c"]).select("row", "col", value)


def resample_bilinear(cells: DataFrame, source: Grid, target: Grid, to_source: Transform | None = None, value: str = "value") -> DataFrame:
    """Weighted mean of the valid ones among the four source cells around each target centre."""
    t = _targets(cells, target, to_source)
    fr = (F.col("y") - source.origin_y) / source.res_y - 0.5
    fc = (F.col("x") - source.origin_x) / source.res_x - 0.5
    t = t.withColumn("_fr", fr).withColumn("_fc", fc).withColumn("_r0", F.floor("_fr").cast("int")).withColumn("_c0", F.floor("_fc").cast("int"))
    wr, wc = F.col("_fr") - F.col("_r0"), F.col("_fc") - F.col("_c0")
    corners = F.array(
        *[
            F.struct((F.col("_r0") + i).alias("_r"), (F.col("_c0") + j).alias("_c"), ((wr if i else 1 - wr) * (wc if j else 1 - wc)).alias("_w"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    four = t.select("row", "col", F.inline(corners)).where("_w > 0")
    s = cells.where(F.col(value).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    mean = F.sum(F.col("_w") * F.col(value)) / F.sum("_w")
    return four.join(s, ["_r", "_c"]).groupBy("row", "col").agg(mean.alias(value))
