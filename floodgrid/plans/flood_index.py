"""From routing to flood index, water depth and hazard scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.functions import hazard as hz
from floodgrid.functions.quantiles import group_stats
from floodgrid.functions.skew import join_hot
from floodgrid.operators import hydro
from floodgrid.operators.components import remove_small
from floodgrid.operators.grid import Grid
from floodgrid.operators.nested import nested_components
from floodgrid.runtime import materialize

# Scenario name, mask kind and fuzzy spread.
SCENARIOS = [("M175", "manual", 1.75), ("M250", "manual", 2.5), ("P175", "physical", 1.75), ("P250", "physical", 2.5)]


def river_heights(
    flow: DataFrame, acc: DataFrame, channels: DataFrame, cell_area: float, mask: DataFrame | None = None
) -> DataFrame:
    """Per cell: target channel, height above it (h, h_adj), its accumulation and depth hr.

    ``flow`` has id, row, col, next, value. Unresolved cells keep NULLs.
    """
    cells = flow.join(hydro.channel_targets(flow, channels), "id")
    if mask is not None:
        cells = cells.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    ends = (
        channels.select("row", "col", "acc")
        .join(flow.select("id", "row", "col", "value"), ["row", "col"])
        .select(F.col("id").alias("target"), F.col("acc").alias("ariver"), F.col("value").alias("_cz"))
    )
    # A main stem's last cells may be the target of a large share of all cells.
    out = join_hot(materialize(cells), ends, "target", how="left")
    h = hz.height_above(F.col("value"), F.col("_cz"))
    return out.select(
        "id",
        "row",
        "col",
        "value",
        "target",
        "ariver",
        h.alias("h"),
        hz.adjusted_height(h).alias("h_adj"),
        hz.river_depth(F.col("ariver"), cell_area).alias("hr"),
    )


def normalise(cells: DataFrame, raw: str = "gfi", name: str = "norm") -> DataFrame:
    """Adds the index scaled to [-1, 1]; fails when there is no range to scale by."""
    low = cells.agg(F.min(raw)).scalar()
    high = cells.agg(F.max(raw)).scalar()
    x = F.when(F.col("_hi") > F.col("_lo"), hz.min_max_pm1(F.col(raw), F.col("_lo"), F.col("_hi")))
    return (
        cells.withColumn("_lo", low)
        .withColumn("_hi", high)
        .withColumn(name, x.otherwise(F.raise_error(F.lit("degenerate flood index range"))))
        .drop("_lo", "_hi")
    )


def flood_index_table(
    flow: DataFrame,
    acc: DataFrame,
    channels: DataFrame,
    grid: Grid,
    cell_area: float,
    mask: DataFrame | None = None,
) -> DataFrame:
    """Heights, raw and normalised index, and water depth wd = hr - h per analysis cell."""
    heights = river_heights(flow, acc, channels, cell_area, mask)
    raw = heights.withColumn("gfi", hz.flood_index(F.col("hr"), F.col("h_adj")))
    return normalise(materialize(raw)).withColumn("wd", F.col("hr") - F.col("h_adj"))


def prone_mask(
    index: DataFrame, grid: Grid, threshold: float = hz.MANUAL_THRESHOLD, min_pixels: int = hz.MIN_COMPONENT_CELLS
) -> tuple[DataFrame, DataFrame]:
    """Cells above the threshold without small components, and the component counts."""
    return remove_small(index.where(F.col("norm") > threshold), grid, min_pixels)


def routing_counts(index: DataFrame) -> DataFrame:
    h = F.col("h")
    return index.agg(
        F.count("*").alias("analysis_cells"),
        F.count("target").alias("resolved_cells"),
        F.count_if(F.col("target").isNull()).alias("unresolved_cells"),
        F.count_if(h < 0).alias("negative_h_cells"),
        F.count_if(h == 0).alias("zero_h_cells"),
        F.count("gfi").alias("finite_index_cells"),
    )


PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def variable_stats(index: DataFrame, cell_area: float) -> DataFrame:
    """Eleven statistics for each of the five variables, from one long table."""
    area = (F.col("ariver") + 1.0) * cell_area / 1e6
    named = {
        "h_adjusted": F.when(F.col("h") >= 0, F.col("h_adj")),
        "ariver_km2": area,
        "hr": F.col("hr"),
        "gfi_raw": F.col("gfi"),
        "gfi_norm": F.col("norm"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), c.alias("x")) for n, c in named.items()])
    long = index.select(F.inline(rows)).where("x is not null")
    x = F.col("x")
    plain = {"cells": F.count(x), "min_value": F.min(x), "mean_value": F.avg(x), "max_value": F.max(x)}
    return group_stats(long, ["variable"], x, PROBS, plain)


def depth_counts(index: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Sign counts and range of the water depth, raw and clamped at zero."""
    cells = index if mask is None else index.join(mask.select("row", "col"), ["row", "col"], "left_semi")
    wd = F.col("wd")
    zero = F.abs(wd) <= 1e-12
    return cells.where("norm is not null").agg(
        F.count(wd).alias("cells"),
        F.count_if(wd < 0).alias("negative_cells"),
        F.count_if(zero).alias("zero_cells"),
        F.count_if(wd > 0).alias("positive_cells"),
        F.min(wd).alias("min_wd"),
        F.avg(wd).alias("mean_wd"),
        F.max(wd).alias("max_wd"),
        F.avg(F.greatest(wd, F.lit(0.0))).alias("mean_clamped_wd"),
    )


def zero_crossing(index: DataFrame) -> DataFrame:
    """Normalised value at raw zero, and cells where wd > 0 and raw > 0 disagree."""
    v = index.where("norm is not null")
    agg = v.agg(
        F.min("gfi").alias("raw_min"),
        F.max("gfi").alias("raw_max"),
        F.count_if((F.col("wd") > 0) != (F.col("gfi") > 0)).alias("disagreeing_cells"),
    )
    return agg.withColumn("norm_at_zero", hz.min_max_pm1(F.lit(0.0), F.col("raw_min"), F.col("raw_max")))


def threshold_sensitivity(
    index: DataFrame, grid: Grid, thresholds: list[float], cell_area: float, min_pixels: int = hz.MIN_COMPONENT_CELLS
) -> DataFrame:
    """Area, depth signs, components and agreement with wd > 0 for every threshold, from one merge tree."""
    v = index.where("norm is not null").select("row", "col", "norm", "wd")
    wd = F.col("wd")
    rising = sorted({float(t) for t in thresholds})
    passed = reduce(lambda x, y: x + y, [(F.col("norm") > t).cast("int") for t in rising])
    signs = {"positive_wd_cells": wd > 0, "negative_wd_cells": wd < 0, "zero_wd_cells": F.abs(wd) <= 1e-12}
    counted = v.select("row", "col", passed.alias("level"), *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in signs.items()])
    parts = nested_components(counted, grid, len(rising), list(signs))
    large = F.col("n") >= min_pixels
    kept = lambda c: F.sum(F.when(large, F.col(c)).otherwise(0))
    found = parts.groupBy("level").agg(
        F.count("*").alias("components_before"),
        F.count_if(large).alias("components_after"),
        kept("n").alias("cells"),
        *[kept(n).alias(n) for n in signs],
        F.max(F.when(large, F.col("n"))).alias("largest"),
    )
    totals = v.agg(F.count("*").alias("valid"), F.count_if(wd > 0).alias("physical"))
    spark = index.sparkSession
    every = F.broadcast(spark.createDataFrame([(float(t), rising.index(float(t)) + 1) for t in thresholds], "threshold double, level int"))
    out = (
        every.join(found, "level", "left")
        .withColumn("valid", totals.select("valid").scalar())
        .withColumn("physical", totals.select("physical").scalar())
        .fillna(0)
    )
    n, pos, phys = F.col("cells"), F.col("positive_wd_cells"), F.col("physical")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return out.select(
        "threshold",
        n.alias("cells"),
        (n * cell_area / 1e6).alias("area_km2"),
        ratio(100.0 * n, F.col("valid")).alias("percent_valid"),
        pos.alias("positive_wd_cells"),
        F.col("negative_wd_cells"),
        F.col("zero_wd_cells"),
        "components_before",
        "components_after",
        (F.col("largest") * cell_area / 1e6).alias("largest_km2"),
        ratio(pos, n).alias("physical_precision"),
        ratio(pos, phys).alias("physical_recall"),
        ratio(pos, n + phys - pos).alias("physical_jaccard"),
    )


def scenario_config() -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("mask"), F.lit(s).alias("spread"))
            for n, m, s in SCENARIOS
        ]
    )


def hazard_scenarios(index: DataFrame, midpoint: float = hz.FUZZY_MIDPOINT, threshold: float = hz.MANUAL_THRESHOLD) -> DataFrame:
    """(scenario, mask, spread, row, col, wd, depth, hazard, cls) for the cells of each mask."""
    v = index.where("norm is not null").select("row", "col", "wd", "norm", "gfi")
    mine = F.filter(
        scenario_config(),
        lambda s: F.when(s["mask"] == "manual", F.col("norm") > threshold).otherwise(F.col("gfi") > 0),
    )
    each = v.select("row", "col", "wd", F.inline(mine))
    depth = F.greatest("wd", F.lit(0.0))
    out = each.withColumn("depth", depth)
    out = out.withColumn("hazard", hz.fuzzy_large(F.col("depth"), midpoint, F.col("spread")))
    return out.withColumn("cls", hz.hazard_class(F.col("hazard")))


def scenario_summary(hazard: DataFrame, cell_area: float) -> DataFrame:
    n = F.count("*")
    km2 = cell_area / 1e6
    classes = {1: "low", 2: "medium", 3: "high"}
    counts = {name: F.count_if(F.col("cls") == k) for k, name in classes.items()}
    return hazard.groupBy("scenario", "mask", "spread").agg(
        n.alias("cells"),
        (n * km2).alias("area_km2"),
        F.count_if(F.col("wd") < 0).alias("negative_wd_cells"),
        F.count_if(F.col("wd") > 0).alias("positive_wd_cells"),
        *[(c * km2).alias(f"{name}_km2") for name, c in counts.items()],
        *[(100.0 * c / n).alias(f"{name}_percent") for name, c in counts.items()],
    )


def method_comparison(
    flow: DataFrame, acc: DataFrame, channel_sets: dict[str, DataFrame], grid: Grid, cell_area: float
) -> DataFrame:
    """Channels, routing, prone area with its components, and depth signs for several channel definitions."""
    rows = []
    for name, channels in channel_sets.items():
        index = materialize(flood_index_table(flow, acc, channels, grid, cell_area))
        kept, removal = prone_mask(index, grid)
        prone = kept.select("row", "col", F.lit(True).alias("prone"))
        wd, p = F.col("wd"), F.col("prone")
        rows.append(
            index.join(prone, ["row", "col"], "left").agg(
                F.lit(name).alias("method"),
                F.count("*").alias("analysis_cells"),
                F.count("target").alias("resolved_cells"),
                F.count_if(F.col("target").isNull()).alias("unresolved_cells"),
                F.count_if(F.col("target") == F.col("id")).alias("channel_cells"),
                F.min("gfi").alias("min_index"),
                F.max("gfi").alias("max_index"),
                F.count_if(F.col("h") < 0).alias("negative_h_cells"),
                F.count("gfi").alias("finite_index_cells"),
                F.count_if(p).alias("prone_cells"),
                (F.count_if(p) * cell_area / 1e6).alias("prone_km2"),
                F.count_if(p & (wd < 0)).alias("prone_negative_wd_cells"),
                F.count_if(p & (wd > 0)).alias("prone_positive_wd_cells"),
                F.count_if(wd > 0).alias("physical_cells"),
            ).withColumns({c: removal.select(c).scalar() for c in ("components_before", "components_after")})
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def method_statistics(flow: DataFrame, acc: DataFrame, channel_sets: dict[str, DataFrame], grid: Grid, cell_area: float) -> tuple[DataFrame, DataFrame]:
    """What the comparison reports beside its counts, for several channel definitions.

    Per method: share of resolved cells, cells of height zero, the normalised value at a raw index of
    zero, and shares of prone cells with negative and positive depth. Per method and variable: the
    distribution of height (not negative), river depth, index, and depth of all prone and of positive prone cells.
    """
    parts = []
    for name, channels in channel_sets.items():
        index = materialize(flood_index_table(flow, acc, channels, grid, cell_area))
        kept, _ = prone_mask(index, grid)
        prone = kept.select("row", "col", F.lit(True).alias("prone"))
        parts.append(index.join(prone, ["row", "col"], "left").withColumn("method", F.lit(name)))
    cells = materialize(reduce(lambda x, y: x.unionByName(y), parts))
    wd, p = F.col("wd"), F.coalesce("prone", F.lit(False))
    percent = lambda c, of: F.when(of > 0, 100.0 * c / of).otherwise(0.0)
    lo, hi = F.min("gfi"), F.max("gfi")
    shares = cells.groupBy("method").agg(
        percent(F.count("target"), F.count("*")).alias("resolved_percent"),
        F.count_if(F.col("h") == 0).alias("zero_h_cells"),
        (2.0 * ((0.0 - lo) / (hi - lo) - 0.5)).alias("zero_index_threshold"),
        percent(F.count_if(p & (wd < 0)), F.count_if(p)).alias("prone_negative_percent"),
        percent(F.count_if(p & (wd > 0)), F.count_if(p)).alias("prone_positive_percent"),
        (F.count_if(F.col("gfi") > 0) * cell_area / 1e6).alias("physical_km2"),
    )
    named = {
        "height": F.when(F.col("h") >= 0, F.col("h_adj")),
        "river_depth": F.col("hr"),
        "index": F.col("gfi"),
        "depth_prone": F.when(p, wd),
        "depth_positive": F.when(p & (wd > 0), wd),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), c.alias("x")) for n, c in named.items()])
    long = cells.select("method", F.inline(rows)).where("x is not null")
    x = F.col("x")
    plain = {"cells": F.count(x), "min_value": F.min(x), "mean_value": F.avg(x), "max_value": F.max(x)}
    return shares, group_stats(long, ["method", "variable"], x, PROBS, plain)
