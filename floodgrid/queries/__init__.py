"""Registered queries; importing the area modules fills the registry."""

from floodgrid.queries import feature_queries, flow_queries, grid_queries, hazard_queries, scene_queries, terrain_queries  # noqa: F401
from floodgrid.queries import file_queries, scale_queries  # noqa: F401
from floodgrid.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
