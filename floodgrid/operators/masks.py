"""Mask algebra and comparison of cell sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.quantiles import group_stats

CELL = ["row", "col"]


def flags(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per cell of either mask with booleans ``in_a`` and ``in_b``.

    A union with one grouping: one shuffle for both masks, duplicates removed on the way.
    """
    k = (keys or []) + CELL
    both = a.select(*k, F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(
        b.select(*k, F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    )
    return both.groupBy(*k).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return flags(a, b).where("in_a and in_b").select(*CELL)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return flags(a, b).where("in_a and not in_b").select(*CELL)


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells in both, either, only a, only b; IoU, Dice and equality, in one aggregate."""
    f = flags(a, b, keys)
    g = f.groupBy(*keys) if keys else f
    counts = g.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("intersection_cells"),
        F.count("*").alias("union_cells"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a_cells"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b_cells"),
    )
    i, u = F.col("intersection_cells"), F.col("union_cells")
    return counts.select(
        "*",
        F.when(u > 0, i / u).otherwise(0.0).alias("iou"),
        F.when(u > 0, 2 * i / (u + i)).otherwise(0.0).alias("dice"),
        (i == u).alias("identical"),
    )


def agreement_classes(reference: DataFrame, model: DataFrame) -> DataFrame:
    """1 both, 2 reference only, 3 model only."""
    c = F.when(F.col("in_a") & F.col("in_b"), 1).when(F.col("in_a"), 2).otherwise(3)
    return flags(reference, model).select(*CELL, c.alias("agreement"))


def subset_capture(zone: DataFrame, mask: DataFrame, cell_area: float) -> DataFrame:
    """How much of the zone lies inside the mask."""
    counts = flags(zone, mask).agg(
        F.count_if("in_a").alias("zone_cells"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("captured_cells"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("remaining_cells"),
    )
    n = F.col("zone_cells")
    return counts.select(
        "*",
        (F.col("captured_cells") * cell_area / 1e6).alias("captured_km2"),
        (F.col("remaining_cells") * cell_area / 1e6).alias("remaining_km2"),
        F.when(n > 0, F.col("captured_cells") / n).otherwise(0.0).alias("captured_fraction"),
        F.when(n > 0, F.col("remaining_cells") / n).otherwise(0.0).alias("remaining_fraction"),
    )


def difference_stats(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """b - a over cells valid in both: changes beyond 1e-6, moves beyond 0.001, distribution."""
    d = a.select(*CELL, F.col(value).alias("_a")).join(
        b.select(*CELL, F.col(value).alias("_b")), CELL
    )
    d = d.select((F.col("_b") - F.col("_a")).alias("delta"))
    x = F.col("delta")
    return group_stats(
        d,
        [],
        x,
        {"p01_delta": 0.01, "p99_delta": 0.99},
        {
            "compared_cells": F.count(x),
            "changed_cells": F.count_if(F.abs(x) > 1e-6),
            "raised_cells": F.count_if(x > 0.001),
            "lowered_cells": F.count_if(x < -0.001),
            "mean_delta": F.avg(x),
            "mean_abs_delta": F.avg(F.abs(x)),
            "min_delta": F.min(x),
            "max_delta": F.max(x),
        },
    )
