"""Column expressions for flood index, depth, fuzzy hazard and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method.
HR_EXPONENT = 0.354429752
MANUAL_THRESHOLD = -0.53
MIN_COMPONENT_CELLS = 8
FUZZY_MIDPOINT = 1.125


def height_above(cell_z: Column, channel_z: Column) -> Column:
    return cell_z - channel_z


def adjusted_height(height: Column) -> Column:
    """Zero height becomes 1e-5; negative heights stay and give no index."""
    return F.when(height == 0, F.lit(1e-5)).otherwise(height)


def river_depth(acc_cells: Column, cell_area: float) -> Column:
    """hr from the area draining to the channel cell, one extra cell included."""
    return F.pow((acc_cells + 1.0) * cell_area / 1e6, F.lit(HR_EXPONENT))


def flood_index(hr: Column, adjusted: Column) -> Column:
    return F.when(adjusted > 0, F.ln(hr / adjusted))


def min_max_pm1(x: Column, low: Column, high: Column) -> Column:
    return 2.0 * (F.try_divide(x - low, high - low) - 0.5)


def fuzzy_large(x: Column, midpoint: float | Column, spread: float | Column) -> Column:
    """1 / (1 + (x / midpoint)^-spread); 0 at or below zero, NULL stays NULL."""
    power = F.pow(x / midpoint, -spread if isinstance(spread, Column) else F.lit(-spread))
    return F.when(x <= 0, F.lit(0.0)).when(x > 0, 1.0 / (1.0 + power))


def hazard_class(h: Column) -> Column:
    return F.when(h <= 0.333, 1).when(h <= 0.666, 2).when(h.isNotNull(), 3)
