"""Adapters that read the supplied tables as rasters, features, scenes and points."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgrid.functions.hazard import MANUAL_THRESHOLD
from floodgrid.operators import hydro, vector
from floodgrid.operators.grid import Grid
from floodgrid.plans import flood_index
from floodgrid.runtime import by_shuffle, materialize, small_tasks

WIDTH = 100
CELL_AREA = 69.381334
MIDPOINT = 0.3
CHANNEL_CELLS = 100

_SHARED: dict[tuple, object] = {}


def forget() -> None:
    """Drop shared steps, so that the next query computes everything itself."""
    _SHARED.clear()


def shared(fn: Callable) -> Callable:
    """Compute a step once per session and data folder; tables are written and read back."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _SHARED:
            out = fn(spark, sf)
            _SHARED[key] = materialize(out) if isinstance(out, DataFrame) else out
        return _SHARED[key]

    return run


# Tables whose columns make cells and geometry; their joins go by shuffle.
LARGE = ("orders", "lineitem", "customer", "supplier", "part")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_tasks(spark)
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return by_shuffle(rows) if name in LARGE else rows


@shared
def grid(spark, sf) -> Grid:
    last = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return Grid(width=WIDTH, height=(last // WIDTH if last is not None else -1) + 1)


def _cells(spark, sf, divisor: float) -> DataFrame:
    k = F.col("o_orderkey")
    row, col = F.floor(k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    z = 0.2 * row.cast("double") + 0.05 * F.abs(col - 50).cast("double") + F.col("o_totalprice") / divisor
    return table(spark, sf, "orders").select(
        row.alias("row"), col.alias("col"), z.alias("value"), "o_orderstatus", "o_orderpriority"
    )


def dem(spark, sf) -> DataFrame:
    return _cells(spark, sf, 5e6).select("row", "col", "value")


def dem_alt(spark, sf) -> DataFrame:
    return _cells(spark, sf, 4e6).select("row", "col", "value")


def dem_nodata(spark, sf) -> DataFrame:
    gap = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return _cells(spark, sf, 5e6).select(
        "row", "col", F.when(gap, -9999.0).otherwise(F.col("value")).alias("value")
    )


@shared
def flow(spark, sf) -> DataFrame:
    g = grid(spark, sf)
    return hydro.with_next(hydro.d8_pointer(dem(spark, sf), g), g)


@shared
def acc(spark, sf) -> DataFrame:
    return hydro.flow_accumulation(flow(spark, sf), grid(spark, sf))


def channels(spark, sf) -> DataFrame:
    return hydro.streams(acc(spark, sf), CHANNEL_CELLS)


@shared
def index(spark, sf) -> DataFrame:
    """Routing, heights, flood index and water depth for every cell."""
    return flood_index.flood_index_table(
        flow(spark, sf), acc(spark, sf), channels(spark, sf), grid(spark, sf), CELL_AREA
    )


@shared
def hazard(spark, sf) -> DataFrame:
    return flood_index.hazard_scenarios(index(spark, sf), MIDPOINT, MANUAL_THRESHOLD)


def _ring(points: list[tuple[float, float]], h: float):
    i = (F.col("n_nationkey") % 5).cast("double")
    j = F.floor(F.col("n_nationkey") / 5).cast("double")
    return F.array(*[F.array(i * 20.0 + dx, (j + fy) * h / 5.0) for dx, fy in points])


# The outline and the hole of the slanted test zones (x offset, share of a zone row).
OUTLINE = [(1.3, 0.07), (21.1, 0.11), (18.7, 1.05), (-2.2, 0.93), (1.3, 0.07)]
HOLE = [(6.2, 0.35), (12.9, 0.42), (9.4, 0.71), (6.2, 0.35)]


def zones(spark, sf) -> DataFrame:
    """One slanted polygon per nation over a 5 x 5 layout; every sixth has a hole."""
    h = float(grid(spark, sf).height)
    outer, hole = _ring(OUTLINE, h), _ring(HOLE, h)
    rings = F.when(F.col("n_nationkey") % 6 == 2, F.array(outer, hole)).otherwise(F.array(outer))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("rk"), "r_name", F.array(rings).alias("coords")
    )


def zone_edges(spark, sf) -> DataFrame:
    return vector.edges(zones(spark, sf), ["k"])


@shared
def zone_cells(spark, sf) -> DataFrame:
    return vector.rasterize_polygons(zone_edges(spark, sf), grid(spark, sf), ["k"])


def named_zone_cells(spark, sf) -> DataFrame:
    names = zones(spark, sf).select("k", "n_name", "rk", "r_name")
    # One row per nation.
    return zone_cells(spark, sf).join(F.broadcast(names), "k")


@shared
def basin(spark, sf) -> DataFrame:
    """The zones of all regions but the first."""
    return named_zone_cells(spark, sf).where("rk <> 0").select("row", "col").distinct()


# Bends of the test rivers (x offset, share of the grid height).
BENDS = [(10.25, 0.02), (17.25, 0.27), (5.25, 0.51), (14.25, 0.74), (7.25, 0.98)]


def rivers(spark, sf) -> DataFrame:
    """One polyline per region."""
    h = float(grid(spark, sf).height)
    x = F.col("r_regionkey").cast("double") * 20.0
    path = F.array(*[F.array(x + dx, F.lit(fy) * h) for dx, fy in BENDS])
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("k"), "r_name", F.array(F.array(path)).alias("coords")
    )


def river_edges(spark, sf) -> DataFrame:
    return vector.edges(rivers(spark, sf), ["k"])


@shared
def river_cells(spark, sf) -> DataFrame:
    return vector.rasterize_lines(river_edges(spark, sf), grid(spark, sf), []).distinct()


@shared
def observed(spark, sf) -> DataFrame:
    k = F.col("l_orderkey")
    return (
        table(spark, sf, "lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08))
        .select(F.floor(k / WIDTH).cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"))
        .distinct()
    )


def points(spark, sf) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        (1000.0 * e[0].cast("double")).alias("x"),
        (1000.0 * e[1].cast("double")).alias("y"),
        F.col("label").alias("beam"),
        F.when(F.col("vec_id") % 2 == 1, "POST").otherwise("PRE").alias("date"),
    )


def with_id(cells: DataFrame) -> DataFrame:
    return cells.withColumn("id", F.col("row").cast("long") * WIDTH + F.col("col"))
