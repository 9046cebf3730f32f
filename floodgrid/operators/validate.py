"""Agreement of modelled and observed flood extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.operators.distance import square_reach
from floodgrid.operators.masks import flags

CONFUSION = {"tn": 1, "tp": 2, "fp": 3, "fn": 4}


def confusion_cells(domain: DataFrame, predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(domain columns, pred, obs): both flags for every domain cell."""
    f = flags(predicted, observed).select("row", "col", F.col("in_a").alias("pred"), F.col("in_b").alias("obs"))
    return domain.join(f, ["row", "col"], "left").fillna(False, ["pred", "obs"])


def confusion_class() -> Column:
    p, o = F.col("pred"), F.col("obs")
    return F.when(p & o, 2).when(p, 3).when(o, 4).otherwise(1)


def confusion_metrics(cells: DataFrame, keys: list[str], cell_area: float) -> DataFrame:
    """Counts, areas and scores per key; a zero denominator gives NULL."""
    p, o = F.col("pred"), F.col("obs")
    g = cells.groupBy(*keys) if keys else cells
    c = g.agg(
        F.count_if(p & o).alias("tp_cells"),
        F.count_if(p & ~o).alias("fp_cells"),
        F.count_if(~p & o).alias("fn_cells"),
        F.count_if(~p & ~o).alias("tn_cells"),
    )
    return with_scores(c, cell_area)


def with_scores(counts: DataFrame, cell_area: float) -> DataFrame:
    tp, fp, fn, tn = (F.col(f"{k}_cells") for k in ("tp", "fp", "fn", "tn"))
    km2 = cell_area / 1e6

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(
        "*",
        (tp + fp + fn + tn).alias("zone_cells"),
        ((tp + fp) * km2).alias("predicted_km2"),
        ((tp + fn) * km2).alias("observed_km2"),
        ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp + fn).alias("iou"),
        spec.alias("specificity"),
        ((recall + spec) / 2.0).alias("balanced_accuracy"),
    )


def scenario_flags(domain: DataFrame, hazard: DataFrame, observed: DataFrame, scenarios: list[str]) -> DataFrame:
    """(scenario, row, col, pred, obs) over the domain, one pass for all scenarios."""
    sc = F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
    obs = observed.select("row", "col", F.lit(True).alias("obs"))
    base = domain.select("row", "col").join(obs, ["row", "col"], "left").fillna(False, ["obs"])
    pred = hazard.groupBy("row", "col").agg(F.collect_set("scenario").alias("_in"))
    both = base.join(pred, ["row", "col"], "left").select("row", "col", "obs", "_in", sc)
    member = F.coalesce(F.array_contains("_in", F.col("scenario")), F.lit(False))
    return both.withColumn("pred", member).drop("_in")


def by_zone(
    cells: DataFrame, zone_cells: DataFrame, zones: DataFrame, zone_key: str, scenarios: list[str], cell_area: float,
    keep_empty: bool,
) -> DataFrame:
    """Scores per scenario and zone; zones without cells are kept with zeros or left out."""
    p, o = F.col("pred"), F.col("obs")
    counts = (
        zone_cells.select(zone_key, "row", "col")
        .join(cells, ["row", "col"])
        .groupBy("scenario", zone_key)
        .agg(
            F.count_if(p & o).alias("tp_cells"),
            F.count_if(p & ~o).alias("fp_cells"),
            F.count_if(~p & o).alias("fn_cells"),
            F.count_if(~p & ~o).alias("tn_cells"),
        )
    )
    if keep_empty:
        sc = F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
        counts = zones.select(zone_key).distinct().select(zone_key, sc).join(
            counts, ["scenario", zone_key], "left"
        ).fillna(0)
    return with_scores(counts, cell_area)


def observed_composition(observed: DataFrame, hazard: DataFrame, scenarios: list[str], cell_area: float) -> DataFrame:
    """Observed cells in each modelled class per scenario; absent classes show zero."""
    classes = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), F.lit(k).alias("cls"), F.lit(n).alias("class"))
            for s in scenarios
            for k, n in ((1, "LOW"), (2, "MEDIUM"), (3, "HIGH"))
        ]
    )
    spark = observed.sparkSession
    every = spark.range(1).select(F.inline(classes))
    n = (
        hazard.join(observed.select("row", "col"), ["row", "col"], "left_semi")
        .groupBy("scenario", "cls")
        .agg(F.count("*").alias("n"))
    )
    total = observed.agg(F.count("*")).scalar()
    out = F.broadcast(every).join(n, ["scenario", "cls"], "left").withColumn("_t", total)
    cells = F.coalesce("n", F.lit(0))
    return out.select(
        "scenario",
        "class",
        cells.alias("observed_cells"),
        (cells * cell_area / 1e6).alias("observed_km2"),
        F.when(F.col("_t") > 0, 100.0 * cells / F.col("_t")).alias("pct_of_observed"),
    )


def positional_tolerance(
    hazard: DataFrame, observed: DataFrame, radii: list[int], scenarios: list[str], cell_area: float
) -> DataFrame:
    """Recall near predictions and precision near observations for square radii.

    A dilation by r reaches a cell exactly when its square distance is at most r, so one search
    up to the largest radius serves all radii.
    """
    spark = observed.sparkSession
    reach = max(radii)
    kinds = F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
    obs = observed.select("row", "col").distinct()
    pred = hazard.select("scenario", "row", "col")
    found = square_reach(obs.select("row", "col", kinds), pred, reach, ["scenario"])
    # Observations do not depend on the scenario; predictions of all scenarios ask them at once.
    spots = pred.groupBy("row", "col").agg(F.collect_set("scenario").alias("_s"))
    backed = square_reach(spots, obs, reach).join(spots, ["row", "col"]).select(F.explode("_s").alias("scenario"), "steps")
    counts = lambda df, name: df.groupBy("scenario").agg(
        *[F.count_if(F.col("steps") <= r).alias(f"{name}{r}") for r in radii]
    )
    sizes = pred.groupBy("scenario").agg(F.count("*").alias("n_pred"))
    every = F.broadcast(spark.range(1).select(kinds))
    wide = every.join(counts(found, "a"), "scenario", "left").join(counts(backed, "b"), "scenario", "left")
    wide = wide.join(sizes, "scenario", "left").fillna(0).withColumn("n_obs", obs.agg(F.count("*")).scalar())
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("radius"), F.col(f"a{r}").alias("captured"), F.col(f"b{r}").alias("confirmed"))
            for r in radii
        ]
    )
    out = wide.select("scenario", "n_pred", "n_obs", F.inline(rows))
    km2 = cell_area / 1e6
    out = out.withColumn("recall", F.when(F.col("n_obs") > 0, F.col("captured") / F.col("n_obs"))).withColumn(
        "precision", F.when(F.col("n_pred") > 0, F.col("confirmed") / F.col("n_pred"))
    )
    p, r = F.col("precision"), F.col("recall")
    return out.select(
        "scenario",
        "radius",
        (F.col("captured") * km2).alias("captured_km2"),
        (F.col("confirmed") * km2).alias("confirmed_km2"),
        "recall",
        "precision",
        F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"),
    )


def provenance_gate(features: DataFrame, required: dict[str, str], excluded: dict[str, str]) -> DataFrame:
    """One row: is each required text present in its column, is each excluded one found.

    Texts are compared without case as substrings; ``accepted`` needs all required and no excluded.
    """

    def found(col: str, text: str) -> Column:
        return F.coalesce(F.bool_or(F.upper(F.col(col)).contains(text.upper())), F.lit(False))

    need = [found(c, t).alias(f"has_{c}") for c, t in required.items()]
    bad = [found(c, t).alias(f"conflict_{c}") for c, t in excluded.items()]
    out = features.agg(*need, *bad)
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(f"has_{c}")
    for c in excluded:
        ok = ok & ~F.col(f"conflict_{c}")
    return out.withColumn("accepted", ok)


def distinct_in_order(values: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Non-blank distinct values per key with the position of their first appearance."""
    v = F.trim(F.col(value))
    return (
        values.where(v.isNotNull() & (v != ""))
        .groupBy(key, v.alias(value))
        .agg(F.min(order).alias("first_seen"))
    )


def attribute_keys(features: DataFrame, attrs: str, order: str) -> DataFrame:
    """Union of the keys of a map column with the first row that has each."""
    keys = features.select(order, F.posexplode(F.map_keys(attrs)).alias("_k", "key"))
    return keys.groupBy("key").agg(F.min(order).alias("first_seen"))


def clip_versus_union(feature_cells: DataFrame, key: str, cell_area: float) -> DataFrame:
    """Sum of the feature areas against the area of their union."""
    per_cell = feature_cells.select(key, "row", "col").distinct().groupBy("row", "col").agg(F.count("*").alias("n"))
    return per_cell.agg(
        (F.sum("n") * cell_area / 1e4).alias("sum_ha"), (F.count("*") * cell_area / 1e4).alias("union_ha")
    ).withColumn("overlap_ha", F.col("sum_ha") - F.col("union_ha"))


def ranked_zones(scores: DataFrame, zone_key: str, top: int = 10) -> DataFrame:
    """Per scenario the leading zones by observed area and by missed area, observed > 0 only.

    The zones of a level are a short list, so a window per scenario is small.
    """
    seen = scores.where("observed_km2 > 0")
    by_obs = Window.partitionBy("scenario").orderBy(F.desc("observed_km2"), zone_key)
    by_fn = Window.partitionBy("scenario").orderBy(F.desc("fn_cells"), zone_key)
    ranked = seen.withColumn("observed_rank", F.row_number().over(by_obs)).withColumn(
        "missed_rank", F.row_number().over(by_fn)
    )
    return ranked.where((F.col("observed_rank") <= top) | (F.col("missed_rank") <= top))
