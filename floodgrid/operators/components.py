"""Summaries and filters over labelled components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.ranking import global_rank
from floodgrid.operators.grid import Grid
from floodgrid.operators.tilegraph import label_components
from floodgrid.runtime import materialize


def remove_small(
    mask: DataFrame, grid: Grid, min_pixels: int = 8, keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cells of components with at least ``min_pixels``, and component counts before and after.

    Cells are filtered by their tile piece, so a component with a third of all cells is not one
    join key; only the short table of pieces meets the component sizes.
    """
    keys = keys or []
    labelled = materialize(label_components(mask, grid, keys, with_piece=True))
    pieces = labelled.groupBy(*keys, "label", "piece").agg(F.count("*").alias("_n"))
    sizes = pieces.groupBy(*keys, "label").agg(F.sum("_n").alias("cells"))
    large = pieces.join(sizes.where(F.col("cells") >= min_pixels), keys + ["label"], "left_semi")
    kept = labelled.join(large.select(*keys, "piece"), keys + ["piece"], "left_semi").drop("piece")
    g = sizes.groupBy(*keys) if keys else sizes
    counts = g.agg(
        F.count("*").alias("components_before"),
        F.count_if(F.col("cells") >= min_pixels).alias("components_after"),
    )
    return kept, counts


def component_summary(
    labelled: DataFrame, grid: Grid, min_area_km2: float = 0.01, top: int = 50
) -> DataFrame:
    """Largest components with area and centre (rounded to the nearest cell)."""
    c = labelled.groupBy("label").agg(
        F.count("*").alias("cells"), F.avg("row").alias("_r"), F.avg("col").alias("_c")
    )
    c = c.withColumn("area_km2", F.col("cells") * grid.cell_area / 1e6)
    c = c.where(F.col("area_km2") >= min_area_km2)
    x = grid.origin_x + (F.rint("_c") + 0.5) * grid.res_x
    y = grid.origin_y + (F.rint("_r") + 0.5) * grid.res_y
    c = c.withColumn("centroid_x", x).withColumn("centroid_y", y).drop("_r", "_c")
    kept = c.orderBy(F.desc("cells"), "label").limit(top)
    return global_rank(kept, [F.desc("cells"), F.asc("label")], "rank")


def component_hotspots(
    labelled: DataFrame, values: DataFrame, grid: Grid, min_cells: int = 3, value: str = "value"
) -> DataFrame:
    """Components of at least ``min_cells`` with their highest value and centre of mass."""
    c = (
        labelled.join(values.select("row", "col", value), ["row", "col"])
        .groupBy("label")
        .agg(
            F.count("*").alias("cells"),
            F.max(value).alias("max_value"),
            (grid.origin_x + (F.avg("col") + 0.5) * grid.res_x).alias("x"),
            (grid.origin_y + (F.avg("row") + 0.5) * grid.res_y).alias("y"),
        )
        .where(F.col("cells") >= min_cells)
        .withColumn("area_m2", F.col("cells") * grid.cell_area)
    )
    return c.orderBy(F.desc("max_value"), F.desc("cells"), "label")
