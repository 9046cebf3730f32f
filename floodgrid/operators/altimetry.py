"""Along-track points: JSON rows, column roles, summaries, nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.functions.projection import lonlat_to_utm
from floodgrid.functions.quantiles import group_percentiles, group_stats
from floodgrid.runtime import write_and_read as materialize

SERIES = "struct<series:array<struct<lat_lon_elev_canopy:array<array<string>>>>>"


def _finite(c: Column) -> Column:
    """Number from text, NULL unless finite."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def parse_series(docs: DataFrame, text: str, keys: list[str], bbox: tuple[float, float, float, float], zone: int = 47) -> DataFrame:
    """Points of ``series[].lat_lon_elev_canopy[]`` inside the box, with UTM coordinates.

    Rows with fewer than four entries or a non-finite position or height are dropped; a
    non-finite canopy becomes NULL.
    """
    s = docs.select(*keys, F.posexplode(F.from_json(text, SERIES)["series"]).alias("series_index", "_s"))
    r = s.select(*keys, "series_index", F.posexplode("_s.lat_lon_elev_canopy").alias("row_index", "_r"))
    p = r.where(F.size("_r") >= 4).select(
        *keys,
        "series_index",
        "row_index",
        _finite(F.col("_r")[0]).alias("lat"),
        _finite(F.col("_r")[1]).alias("lon"),
        _finite(F.col("_r")[2]).alias("h"),
        _finite(F.col("_r")[3]).alias("canopy"),
    )
    inside = F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    x, y = lonlat_to_utm(F.col("lon"), F.col("lat"), zone)
    return p.where(F.col("h").isNotNull() & inside).withColumn("x", x).withColumn("y", y)


# Plausible ranges of latitude, longitude and height for the study region.
LAT_RANGE, LON_RANGE, HEIGHT_RANGE = (-2.0, 1.0), (99.0, 102.0), (-200.0, 5000.0)


# Least share of plausible latitudes, longitudes and heights.
LEAST_SHARES = (0.8, 0.8, 0.5)


def column_roles(rows: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Which array position is latitude, longitude and height, per key.

    Scores are the share of values in a plausible range over all rows; a key whose best scores stay
    below ``LEAST_SHARES`` gets no row. Positions beyond the shortest array do not count.
    """
    width = rows.groupBy(*keys).agg(F.min(F.size(values)).alias("_w"))
    v = F.col("v").cast("double")
    share = lambda r: F.coalesce(F.avg(v.between(*r).cast("double")), F.lit(0.0))
    s = (
        rows.select(*keys, F.posexplode(values).alias("idx", "v"))
        .groupBy(*keys, "idx")
        .agg(share(LAT_RANGE).alias("lat"), share(LON_RANGE).alias("lon"), share(HEIGHT_RANGE).alias("height"))
        .join(width, keys)
        .where("idx < _w and _w >= 3")
    )
    cols = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "lat", "lon", "height"))).alias("c"))

    def best(name: str, arr: Column) -> Column:
        top = F.array_max(F.transform(arr, lambda e: e[name]))
        return F.filter(arr, lambda e: e[name] == top)[0]

    picked = cols.withColumn("la", best("lat", F.col("c"))).withColumn("lo", best("lon", F.col("c")))
    rest = F.filter("c", lambda e: (e["idx"] != F.col("la.idx")) & (e["idx"] != F.col("lo.idx")))
    picked = picked.withColumn("_rest", rest).where(F.size("_rest") > 0).withColumn("el", best("height", F.col("_rest")))
    return picked.where((F.col("la.lat") >= LEAST_SHARES[0]) & (F.col("lo.lon") >= LEAST_SHARES[1]) & (F.col("el.height") >= LEAST_SHARES[2])).select(
        *keys,
        F.col("la.idx").alias("lat_index"),
        F.col("lo.idx").alias("lon_index"),
        F.col("el.idx").alias("height_index"),
        F.col("la.lat").alias("lat_score"),
        F.col("lo.lon").alias("lon_score"),
        F.col("el.height").alias("height_score"),
    )


def _node_kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "broken")
        .when(s.startswith("OBJECT"), "dict")
        .when(s.startswith("ARRAY"), "list")
        .when(s == "STRING", "str")
        .when(s == "BOOLEAN", "bool")
        .when(s.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
        .when(s == "VOID", "null")
        .otherwise("float")
    )


def json_nodes(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Every node of the JSON trees: (keys, depth, path, key, kind, children, v).

    Levels are exploded one after another until none is left, however deep; nodes stay on the
    executors. A text that is not JSON is one node of kind ``broken`` without a value.
    """
    spark = docs.sparkSession
    level = materialize(
        docs.select(*keys, F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(text).alias("v"))
    )
    out = level
    depth = 0
    while True:
        depth += 1
        inner = level.where(_node_kind(F.col("v")).isin("dict", "list"))
        if inner.isEmpty():
            break
        parent = inner.select(*keys, F.col("path").alias("_path"), F.col("v").alias("_v"))
        kids = parent.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = materialize(
            kids.select(*keys, F.lit(depth).alias("depth"), F.concat("_path", step).alias("path"), "key", F.col("value").alias("v"))
        )
        out = out.unionByName(level)
    return out.withColumn("kind", _node_kind(F.col("v")))


def json_tree_summary(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Long report over all trees: node kinds, key frequencies, keys of the roots, beam paths, depth and list lengths."""
    nodes = materialize(json_nodes(docs, text, keys))
    kinds = nodes.groupBy(F.lit("kind").alias("section"), F.col("kind").alias("name")).agg(F.count("*").cast("double").alias("value"))
    names = nodes.where("key is not null").groupBy(F.lit("key").alias("section"), F.col("key").alias("name")).agg(
        F.count("*").cast("double").alias("value")
    )
    roots = nodes.where("depth = 1 and key is not null").groupBy(F.lit("top_key").alias("section"), F.col("key").alias("name")).agg(
        F.count("*").cast("double").alias("value")
    )
    beams = nodes.where(F.col("key").rlike(BEAM)).groupBy(F.lit("beam_path").alias("section"), F.col("path").alias("name")).agg(
        F.count("*").cast("double").alias("value")
    )
    depth = nodes.agg(F.max("depth").cast("double").alias("value")).select(
        F.lit("depth").alias("section"), F.lit("max").alias("name"), "value"
    )
    lists = nodes.where("kind = 'list'").select(F.size(F.col("v").try_cast("array<variant>")).alias("n"))
    lens = group_stats(
        lists, [], "n", {"median": 0.5},
        {"count": F.count("n").cast("double"), "min": F.min("n").cast("double"), "max": F.max("n").cast("double")},
    ) 
    rows = F.array(*[F.struct(F.lit("list_length").alias("section"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("count", "min", "median", "max")])
    return kinds.unionByName(names).unionByName(roots).unionByName(beams).unionByName(depth).unionByName(lens.select(F.inline(rows)))


# Names that mark position and height fields, in order of preference.
LAT_KEYS = ("lat", "latitude", "segment_lat", "lat_ph")
LON_KEYS = ("lon", "lng", "longitude", "segment_lon", "lon_ph")
HEIGHT_KEYS = (
    "h", "elevation", "elev", "height", "h_te_best_fit", "terrain", "terrain_h", "terrain_height",
    "h_mean_canopy_abs", "h_canopy_abs", "h_te_interp",
)
# Fixed value: how a beam is named.
BEAM = "(?i)gt[123][lr]"


def beam_of(path: Column) -> Column:
    """The beam named last in a node's path, in lower case; UNKNOWN without one."""
    named = F.regexp_extract_all(path, F.lit(f"({BEAM})"), F.lit(1))
    return F.coalesce(F.lower(F.try_element_at(named, F.lit(-1))), F.lit("UNKNOWN")).alias("beam")


def _array_elements(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, path, pos, fields, nums): elements of every array as named numbers or numeric row."""
    nodes = json_nodes(docs, text, keys)
    arrays = nodes.where("kind = 'list'").select(*keys, "path", F.posexplode(F.col("v").try_cast("array<variant>")).alias("pos", "e"))
    named = F.transform_values(F.col("e").try_cast("map<string,variant>"), lambda _, v: v.try_cast("double"))
    named = F.transform_keys(named, lambda k, _: F.lower(k))
    return materialize(arrays.select(*keys, "path", "pos", named.alias("fields"), F.col("e").try_cast("array<double>").alias("nums")))


def _array_candidates(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, kind, rows, names, roles): arrays that hold points and where their values are."""
    at = [*keys, "path"]

    def chosen(names: tuple[str, ...]) -> Column:
        """The first name that any element of the array has."""
        return F.coalesce(*[F.max(F.when(F.array_contains(F.map_keys("fields"), n), F.lit(n))) for n in names])

    dicts = (
        elements.where("fields is not null")
        .groupBy(*at)
        .agg(F.count("*").alias("rows"), F.struct(chosen(LAT_KEYS).alias("lat"), chosen(LON_KEYS).alias("lon"), chosen(HEIGHT_KEYS).alias("h")).alias("names"))
        .where("rows >= 2 and names.lat is not null and names.lon is not null and names.h is not null")
        .select(*at, F.lit("dict_rows").alias("kind"), "rows", "names")
    )
    numeric = elements.where("nums is not null and size(nums) >= 3 and not exists(slice(nums, 1, 3), x -> x is null)")
    roles = column_roles(numeric, at, "nums").select(*at, F.struct("lat_index", "lon_index", "height_index").alias("roles"))
    length = F.size("nums")
    counted = numeric.groupBy(*at).agg(F.count("*").alias("rows"), F.min(length).alias("shortest"), F.max(length).alias("longest")).where("rows >= 2")
    nums = counted.join(roles, at).select(*at, F.lit("numeric_rows").alias("kind"), "rows", "shortest", "longest", "roles")
    return dicts.unionByName(nums, allowMissingColumns=True)


def candidate_arrays(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, path, beam, kind, rows, shortest, longest): arrays of objects with position and height, or of numeric rows."""
    found = _array_candidates(_array_elements(docs, text, keys), keys)
    return found.select(*keys, "path", beam_of(F.col("path")), "kind", "rows", "shortest", "longest")


def extract_points(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, path, beam, kind, row_index, lat, lon, height) of the finite rows of all candidate arrays."""
    elements = _array_elements(docs, text, keys)
    found = _array_candidates(elements, keys)
    rows = elements.join(found, [*keys, "path"])

    def value(name: str, index: str) -> Column:
        by_name = F.try_element_at("fields", F.col(f"names.{name}"))
        v = F.when(F.col("kind") == "dict_rows", by_name).otherwise(F.get("nums", F.col(f"roles.{index}")))
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    out = rows.select(
        *keys,
        "path",
        beam_of(F.col("path")),
        "kind",
        F.col("pos").alias("row_index"),
        value("lat", "lat_index").alias("lat"),
        value("lon", "lon_index").alias("lon"),
        value("h", "height_index").alias("height"),
    )
    return out.where("lat is not null and lon is not null and height is not null")


def point_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Box, height range and median, canopy range and median per group."""
    plain = {
        "points": F.count("*"),
        "xmin": F.min("x"),
        "ymin": F.min("y"),
        "xmax": F.max("x"),
        "ymax": F.max("y"),
        "h_min": F.min("h"),
        "h_max": F.max("h"),
        "canopy_valid": F.count("canopy"),
        "canopy_min": F.min("canopy"),
        "canopy_max": F.max("canopy"),
    }
    out = group_stats(points, keys, "h", {"h_median": 0.5}, plain)
    return out.join(group_percentiles(points, keys, "canopy", {"canopy_median": 0.5}), keys, "left")


def beam_sets(points: DataFrame) -> DataFrame:
    """Beams present on both dates, before only or after only."""
    g = points.groupBy("beam").agg(F.max(F.col("date") == "PRE").alias("a"), F.max(F.col("date") == "POST").alias("b"))
    side = F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "pre_only").otherwise("post_only")
    return g.where("a or b").select("beam", side.alias("presence"))


def nearest_distances(points: DataFrame, group: str, finest: float, wide_levels: int = 4) -> DataFrame:
    """(group, date, point_id, dist): distance of each point to the nearest point of the other date.

    ``points`` has point_id, group, date (PRE or POST), x, y. A pyramid of occupied squares, each
    level four times finer, is searched from the top: a point keeps the squares that can still
    hold its nearest neighbour, judged by one real point per square, and only the finest ones
    are compared point by point. No pair of whole buckets is ever formed.
    """
    ext = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, x1, y1 = (float(v) for v in ext)
    side = max(x1 - x0, y1 - y0, finest) * (1 + 1e-9)
    depth = max(1, math.ceil(math.log(side / finest, 4)))
    other = F.when(F.col("date") == "PRE", "POST").otherwise("PRE")
    # Equal positions cannot change a distance.
    targets = points.select(group, other.alias("date"), "x", "y").distinct()
    frontier = points.select("point_id", group, "date", F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    keys = ["point_id", group, "date"]
    for level in range(1, depth + 1):
        size = side / 4**level
        cx, cy = F.floor((F.col("x") - x0) / size), F.floor((F.col("y") - y0) / size)
        squares = (
            targets.withColumn("_cx", cx)
            .withColumn("_cy", cy)
            .groupBy(group, "date", "_cx", "_cy")
            .agg(F.min(F.struct("x", "y")).alias("rep"))
            .withColumn("cx", F.floor(F.col("_cx") / 4))
            .withColumn("cy", F.floor(F.col("_cy") / 4))
        )
        # The upper levels have at most 16^level squares per group; the optimizer picks the join.
        near = frontier.join(squares, [group, "date", "cx", "cy"])
        lo_x, lo_y = x0 + F.col("_cx") * size, y0 + F.col("_cy") * size
        gap = lambda q, lo: F.greatest(lo - q, q - (lo + size), F.lit(0.0))
        near = near.withColumn("_d", F.hypot(F.col("rep.x") - F.col("qx"), F.col("rep.y") - F.col("qy"))).withColumn(
            "_m", F.hypot(gap(F.col("qx"), lo_x), gap(F.col("qy"), lo_y))
        )
        best = F.min("_d").over(Window.partitionBy(*keys))
        frontier = near.withColumn("_b", best).where(F.col("_m") <= F.col("_b") * (1 + 1e-9) + 1e-9).select(
            *keys, "qx", "qy", F.col("_cx").alias("cx"), F.col("_cy").alias("cy")
        )
        if level % wide_levels == 0:
            frontier = materialize(frontier)
    size = side / 4**depth
    homes = targets.select(
        group, "date", "x", "y", F.floor((F.col("x") - x0) / size).alias("cx"), F.floor((F.col("y") - y0) / size).alias("cy")
    )
    d = F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))
    return frontier.join(homes, [group, "date", "cx", "cy"]).groupBy(*keys).agg(F.min(d).alias("dist"))


def nearest_summary(distances: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    within = {f"within_{t:g}": 100.0 * F.count_if(F.col("dist") <= t) / F.count("*") for t in thresholds}
    plain = {"points": F.count("*"), "min_dist": F.min("dist"), "max_dist": F.max("dist"), **within}
    return group_stats(distances, keys, "dist", {"median_dist": 0.5, "p95_dist": 0.95}, plain)
