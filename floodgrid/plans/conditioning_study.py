"""Comparison of conditioning scenarios keyed by their breach distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.operators import hydro, masks
from floodgrid.operators.conditioning import breach_then_fill, route_flats
from floodgrid.operators.distance import distance_within
from floodgrid.operators.grid import Grid
from floodgrid.runtime import write_and_read as materialize


def conditioning_scenarios(
    cells: DataFrame, grid: Grid, distances: list[int], basin: DataFrame, rivers: DataFrame, stream_cells: int, tolerance: float
) -> DataFrame:
    """One row per breach distance: terrain change, main outlet, stream agreement, basin overlap."""
    rows = []
    for d in distances:
        cond = materialize(breach_then_fill(cells, grid, d))
        new = cond.select("row", "col", F.col("conditioned").alias("value"))
        change = masks.difference_stats(cond.select("row", "col", "value"), new)
        flow = materialize(hydro.with_next(route_flats(hydro.d8_pointer(new, grid), grid), grid, within=new))
        acc = materialize(hydro.flow_accumulation(flow, grid))
        inside = hydro.streams(acc, stream_cells, basin)
        main = hydro.top_by_accumulation(inside, 1)
        shed = hydro.watersheds(flow, main, grid)
        overlap = masks.overlap_counts(basin, shed).select("iou", "dice")
        near = inside.join(distance_within(inside, rivers, grid, tolerance), ["row", "col"], "left").agg(
            F.coalesce(F.try_divide(F.count_if(F.col("dist") <= tolerance), F.count("*")), F.lit(0.0)).alias("streams_near_rivers"),
            F.count("*").alias("stream_cells"),
            F.max_by("row", F.struct("acc", -F.col("row"), -F.col("col"))).alias("outlet_row"),
            F.max_by("col", F.struct("acc", -F.col("row"), -F.col("col"))).alias("outlet_col"),
        )
        key = lambda df: df.withColumn("scenario", F.lit(d))  # noqa: B023, E731
        rows.append(key(change).join(key(near), "scenario").join(key(overlap), "scenario"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
