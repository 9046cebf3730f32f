"""Administrative units: names, field detection, dissolve, class statistics, conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = {1: "low", 2: "medium", 3: "high"}


def normalise_text(c: Column) -> Column:
    """Upper case, outer blanks off, runs of blanks to one."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def normalise_name(c: Column) -> Column:
    """As above, with runs of . _ , / \\ - counted as blanks."""
    return normalise_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"[._,/\\-]+", " "))


def canonical_name(c: Column, names: list[str]) -> Column:
    """The first of ``names`` that occurs as a whole word run in the text, else NULL."""
    padded = F.concat(F.lit(" "), normalise_name(c), F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(f" {n} "), F.lit(n)) for n in names])


def unpivot_text(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """(keys, pos, field, value) with every listed column as text."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
            for i, f in enumerate(fields)
        ]
    )
    return df.select(*keys, F.inline(rows))


def detect_field(values: DataFrame, candidates: list[str], expected: list[str]) -> DataFrame:
    """Fields ranked by preferred name first, then by how many expected values they contain.

    ``values`` has (field, value). The first row is the detected field.
    """
    prefer = F.array_position(F.array(*[F.lit(c.upper()) for c in candidates]), F.upper("field"))
    hit = F.when(normalise_text(F.col("value")).isin([e.upper() for e in expected]), normalise_text(F.col("value")))
    out = values.groupBy("field").agg(F.count_distinct(hit).alias("expected_values"))
    out = out.withColumn("preferred", F.when(prefer > 0, prefer).cast("int"))
    return out.orderBy(F.col("preferred").asc_nulls_last(), F.desc("expected_values"), "field")


def text_field_scores(values: DataFrame) -> DataFrame:
    """Distinct non-blank texts per field, numbers not counted."""
    t = normalise_text(F.col("value"))
    is_text = (t != "") & ~t.rlike(r"^[+-]?[0-9]*\.?[0-9]+$")
    return values.groupBy("field").agg(F.count_distinct(F.when(is_text, t)).alias("distinct_texts"))


def value_profile(values: DataFrame, order: str, first: int = 8) -> DataFrame:
    """The first distinct values of each field in order of appearance.

    Values meet at one group per (field, value) and only their first positions are ranked; a
    field's candidates are cut to ``first`` with a mergeable bottom-k before they are listed.
    """
    seen = (
        values.where("value is not null")
        .groupBy("field", "value")
        .agg(F.min(order).alias("_first"))
    )
    part = F.pmod(F.xxhash64("value"), F.lit(64))
    by_part = Window.partitionBy("field", "_p").orderBy("_first", "value")
    some = seen.withColumn("_p", part).withColumn("_r", F.row_number().over(by_part)).where(F.col("_r") <= first)
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy("_first", "value")))
    return ranked.where(F.col("_r") <= first).select("field", F.col("_r").alias("position"), "value")


def zone_class_stats(
    zone_cells: DataFrame, classes: DataFrame, zone_keys: list[str], cell_area: float
) -> DataFrame:
    """Cells, areas and shares of each hazard class per zone.

    ``zone_cells`` (zone keys, row, col) may overlap; ``classes`` has (row, col, cls).
    """
    hit = zone_cells.join(classes.select("row", "col", "cls"), ["row", "col"], "left")
    return class_shares(hit.groupBy(*zone_keys), cell_area)


def class_shares(grouped, cell_area: float) -> DataFrame:
    counts = {name: F.count_if(F.col("cls") == k).alias(f"{name}_cells") for k, name in CLASSES.items()}
    out = grouped.agg(F.count("*").alias("zone_cells"), F.count("cls").alias("hazard_cells"), *counts.values())
    return with_shares(out, cell_area)


def _pct(a: Column, b: Column) -> Column:
    return F.when(b > 0, 100.0 * a / b).otherwise(0.0)


def with_shares(counts: DataFrame, cell_area: float) -> DataFrame:
    """km2, hectares and percentages from zone, hazard and class cell counts."""
    km2, ha = cell_area / 1e6, cell_area / 1e4
    zone, hazard = F.col("zone_cells"), F.col("hazard_cells")
    cols = [
        (zone * km2).alias("zone_km2"),
        (zone * ha).alias("zone_ha"),
        (hazard * km2).alias("hazard_km2"),
        (hazard * ha).alias("hazard_ha"),
        _pct(hazard, zone).alias("hazard_pct_zone"),
    ]
    for name in CLASSES.values():
        n = F.col(f"{name}_cells")
        cols += [
            (n * km2).alias(f"{name}_km2"),
            _pct(n, hazard).alias(f"{name}_pct_hazard"),
            _pct(n, zone).alias(f"{name}_pct_zone"),
        ]
    return counts.select("*", *cols)


def dissolve(zone_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of all features with the same key, each once."""
    return zone_cells.select(*keys, "row", "col").distinct()


def coverage_by_level(pieces: DataFrame, upper: str, lower: str, area: str, basin_area: float | Column) -> DataFrame:
    """Area per lower unit, per upper unit and in total, with unit counts and basin share."""
    total = F.col("_basin") if isinstance(basin_area, Column) else F.lit(float(basin_area))
    src = pieces.withColumn("_basin", basin_area) if isinstance(basin_area, Column) else pieces
    basin = F.max("_basin") if isinstance(basin_area, Column) else total
    out = src.rollup(upper, lower).agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("units"),
        F.sum(area).alias("area"),
        basin.alias("_b"),
    )
    pct = F.when(F.col("_b") > 0, 100.0 * F.col("area") / F.col("_b")).otherwise(0.0)
    return out.withColumn("percent_of_basin", pct).drop("_b")


def focus_units(zones: DataFrame, stats: DataFrame, key: str, names: list[str], name_col: str) -> DataFrame:
    """Statistics of the named units, those without any cell kept with zeros and a flag."""
    picked = zones.where(normalise_text(F.col(name_col)).isin([n.upper() for n in names]))
    joined = picked.join(stats, key, "left")
    numeric = [f.name for f in stats.schema if f.name != key]
    return joined.withColumn("intersects", F.col("zone_cells").isNotNull()).fillna(0, numeric)


def top_zones(stats: DataFrame, by: str, tie: str, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc(by), F.asc(tie)).limit(n)


def conservation(
    levels: DataFrame, basin: DataFrame, fields: list[str], basin_area_field: str, tolerance_pct: float = 0.10
) -> DataFrame:
    """Sums per hierarchy level against the basin: difference, shares, consistency, verdict.

    ``levels`` has (level, fields...) rows per unit; ``basin`` is one row with the same fields.
    """
    sums = levels.groupBy("level").agg(*[F.sum(f).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).cast("double").alias("v")) for f in fields])
    a = sums.select("level", F.inline(rows)).withColumnRenamed("v", "level_sum")
    # One row per metric, a fixed list.
    b = basin.select(F.inline(rows)).withColumnRenamed("v", "basin_total")
    area = basin.select(F.col(basin_area_field).cast("double")).scalar()
    out = a.join(F.broadcast(b), "metric").withColumn("_area", area)
    d = F.col("level_sum") - F.col("basin_total")
    out = out.select(
        "level",
        "metric",
        "level_sum",
        "basin_total",
        d.alias("difference"),
        F.when(F.col("_area") > 0, 100.0 * F.abs(d) / F.col("_area")).otherwise(0.0).alias("pct_of_basin"),
        F.when(F.col("basin_total") > 0, 100.0 * F.abs(d) / F.col("basin_total"))
        .otherwise(0.0)
        .alias("pct_of_metric"),
    )
    # Levels are a fixed short list, so these windows hold a handful of rows.
    per_metric = Window.partitionBy("metric")
    spread = F.max("difference").over(per_metric) - F.min("difference").over(per_metric)
    out = out.withColumn("within_tolerance", F.col("pct_of_basin") <= tolerance_pct)
    return out.withColumn("levels_consistent", spread < 1e-9)


def conservation_verdict(checks: DataFrame) -> DataFrame:
    ok = F.every(F.col("within_tolerance") & F.col("levels_consistent"))
    return checks.agg(F.when(ok, "PASS").otherwise("REVIEW").alias("verdict"), F.count("*").alias("checks"))
