"""Stream threshold sweeps, network comparison and drainage zone profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.quantiles import group_stats
from floodgrid.operators import hydro, masks, vector
from floodgrid.operators.distance import distance_within
from floodgrid.operators.grid import Grid
from floodgrid.runtime import materialize


def threshold_networks(
    flow: DataFrame, acc: DataFrame, thresholds: list[int], mask: DataFrame
) -> DataFrame:
    """(threshold, row, col, pointer): each cell once for every threshold it reaches."""
    levels = F.array(*[F.lit(t) for t in sorted(thresholds)])
    lowest = acc.where(F.col("acc") >= min(thresholds))
    cells = lowest.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi").join(
        flow.select("row", "col", "pointer"), ["row", "col"]
    )
    return cells.select(
        F.explode(F.filter(levels, lambda t: F.col("acc") >= t)).alias("threshold"), "row", "col", "pointer"
    )


def stream_sweep(
    flow: DataFrame,
    acc: DataFrame,
    basin: DataFrame,
    river_cells: DataFrame,
    river_edges: DataFrame,
    grid: Grid,
    thresholds: list[int],
    tolerances: list[float],
) -> DataFrame:
    """Agreement with the official rivers and length for every threshold and tolerance.

    A threshold that no cell reaches has rows of zeros.
    """
    net = materialize(threshold_networks(flow, acc, thresholds, basin))
    rivers = river_cells.join(basin.select("row", "col"), ["row", "col"], "left_semi")
    agree = hydro.proximity_agreement(net, rivers, grid, tolerances, "threshold", thresholds)
    length = hydro.network_metrics(net, grid, ["threshold"], with_components=False).select("threshold", "length_km")
    official = vector.line_length(river_edges, []).select(F.col("length") / 1000.0).scalar()
    out = agree.join(length, "threshold", "left").fillna(0.0, ["length_km"]).withColumn("_o", official)
    return out.select(
        "threshold",
        "tolerance",
        "precision_like",
        "recall_like",
        "f1",
        "f2",
        "length_km",
        (F.col("length_km") / F.col("_o")).alias("length_ratio"),
        F.abs(F.col("length_km") - F.col("_o")).alias("length_gap"),
    )


def network_overlap(a: DataFrame, b: DataFrame, grid: Grid, tolerance: float) -> DataFrame:
    """Cell overlap of two networks and the shares of each within ``tolerance`` of the other."""

    def near(x: DataFrame, y: DataFrame):
        d = x.select("row", "col").join(distance_within(x, y, grid, tolerance), ["row", "col"], "left")
        share = F.try_divide(F.count_if(F.col("dist") <= tolerance), F.count("*"))
        return d.agg(F.coalesce(share, F.lit(0.0))).scalar()

    counts = masks.overlap_counts(a, b).select(
        "intersection_cells", "union_cells", F.col("iou").alias("jaccard")
    )
    return counts.withColumn("a_near_b", near(a, b)).withColumn("b_near_a", near(b, a))


def zone_profile(
    exits: DataFrame,
    labels: DataFrame,
    dem: DataFrame,
    filled: DataFrame,
    acc: DataFrame,
    rivers: DataFrame,
    grid: Grid,
    rank: int,
    stream_cells: int,
    tolerance: float,
    fill_limit: float,
    cell_area: float,
) -> DataFrame:
    """Profile of the rank-k exit zone: main exit, elevation, fill depth, streams near rivers.

    ``exits`` has (outlet_id, label, ...) and ``labels`` maps cells to outlets; the zone is not
    clipped to any other mask.
    """
    exits = materialize(exits)
    zones = hydro.zone_summary(exits, "label").where(F.col("rank") == rank).select("label")
    mine = exits.join(zones, "label", "left_semi")
    main = mine.agg(F.max_by("outlet_id", F.struct("acc", -F.col("outlet_id")))).scalar()
    mine_cells = materialize(labels.join(mine.select("outlet_id"), "outlet_id", "left_semi").select("row", "col"))
    channels = hydro.streams(acc, stream_cells, mine_cells)
    z = (
        mine_cells
        .join(dem.select("row", "col", F.col("value").alias("z")), ["row", "col"])
        .join(filled.select("row", "col", F.col("value").alias("f")), ["row", "col"])
        .join(acc.select("row", "col", "acc"), ["row", "col"])
        .join(distance_within(channels, rivers, grid, tolerance), ["row", "col"], "left")
    )
    fill = F.col("f") - F.col("z")
    stream = F.col("acc") >= stream_cells
    out = group_stats(
        z,
        [],
        "z",
        {"median_z": 0.5},
        {
            "zone_cells": F.count("*"),
            "zone_km2": F.count("*") * cell_area / 1e6,
            "min_z": F.min("z"),
            "max_z": F.max("z"),
            "mean_fill": F.avg(fill),
            "max_fill": F.max(fill),
            "fill_cells": F.count_if(fill > fill_limit),
            "stream_cells": F.count_if(stream),
            "stream_cells_near": F.count_if(stream & (F.col("dist") <= tolerance)),
        },
    )
    return out.withColumn("dominant_exit", main)
