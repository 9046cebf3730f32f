"""The tiled operators with tiles of 16 cells, so that small tables run tile borders and graphs too.

Each has the SQL of the query that uses the default tile.
"""

from __future__ import annotations

from floodgrid.functions.rounding import rounded
from floodgrid.operators import conditioning, distance, hydro
from floodgrid.operators.tilegraph import label_components
from floodgrid.queries import fixtures as fx
from floodgrid.queries.flow_queries import _seeds
from floodgrid.queries.registry import ORACLES, query

TILE = 16


@query(ORACLES["flow_accumulation"])
def flow_accumulation_small_tiles(spark, sf):
    acc = hydro.flow_accumulation(fx.flow(spark, sf), fx.grid(spark, sf), TILE)
    return rounded(acc.withColumn("area_km2", acc["acc"] * fx.CELL_AREA / 1e6))


@query(ORACLES["downstream_propagation"])
def downstream_propagation_small_tiles(spark, sf):
    return hydro.propagate_downstream(fx.flow(spark, sf), _seeds(spark, sf), fx.grid(spark, sf), TILE)


@query(ORACLES["first_downstream_channel"])
def first_downstream_channel_small_tiles(spark, sf):
    return hydro.channel_targets(fx.flow(spark, sf), fx.channels(spark, sf), TILE)


@query(ORACLES["watershed_by_pour_points"])
def watershed_by_pour_points_small_tiles(spark, sf):
    return hydro.watersheds(fx.flow(spark, sf), fx.river_cells(spark, sf), fx.grid(spark, sf), TILE)


@query(ORACLES["connected_components"])
def connected_components_small_tiles(spark, sf):
    return label_components(fx.observed(spark, sf), fx.grid(spark, sf), tile=TILE)


@query(ORACLES["depression_filling"])
def depression_filling_small_tiles(spark, sf):
    return rounded(conditioning.fill_depressions(fx.dem(spark, sf), fx.grid(spark, sf), TILE))


@query(ORACLES["distance_to_rivers"])
def distance_to_rivers_small_blocks(spark, sf):
    return rounded(distance.distance_to(fx.river_cells(spark, sf), fx.grid(spark, sf), block_cols=TILE))


@query(ORACLES["distance_inside_basin"])
def distance_inside_basin_small_blocks(spark, sf):
    return rounded(distance.distance_inside(fx.basin(spark, sf), fx.grid(spark, sf), block_cols=TILE))
