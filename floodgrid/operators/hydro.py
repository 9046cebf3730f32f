"""Flow routing on cell tables: pointers, accumulation, streams, watersheds, outlets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.graph import components
from floodgrid.functions.quantiles import group_stats
from floodgrid.functions.ranking import global_rank
from floodgrid.operators import distance
from floodgrid.operators.focal import nb, neighbourhood
from floodgrid.operators.grid import Grid, cell_id, cell_xy
from floodgrid.operators.tilegraph import TILE, accumulate, first_downstream, label_components
from floodgrid.runtime import materialize

# Pointer codes (power of two from north-east clockwise) as code: (row step, col step).
D8 = {1: (-1, 1), 2: (0, 1), 4: (1, 1), 8: (1, 0), 16: (1, -1), 32: (0, -1), 64: (-1, -1), 128: (-1, 0)}
# The other common coding counts from east clockwise.
EAST_FIRST = {(0, 1): 1, (1, 1): 2, (1, 0): 4, (1, -1): 8, (0, -1): 16, (-1, -1): 32, (-1, 0): 64, (-1, 1): 128}


def _lookup(values: dict[int, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def pointer_step(pointer: Column) -> tuple[Column, Column]:
    """Row and column step of a pointer code; NULL for any other code."""
    p = pointer.cast("int")
    return _lookup({k: s[0] for k, s in D8.items()}, p), _lookup({k: s[1] for k, s in D8.items()}, p)


def d8_pointer(cells: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """Adds ``pointer`` (0 without a lower neighbour); ties go to the smaller code."""
    options = []
    for code, (dr, dc) in D8.items():
        run = math.hypot(dc * grid.res_x, dr * grid.res_y)
        drop = (F.col(value) - nb(dr, dc)) / run
        options.append(F.when(drop > 0, F.struct(drop.alias("drop"), F.lit(-code).alias("neg"))))
    best = F.array_max(F.array(*options))
    around = neighbourhood(cells.where(F.col(value).isNotNull()), value)
    return around.withColumn("pointer", F.coalesce(-best["neg"], F.lit(0))).drop("nb")


def recode_pointer(pointer: Column) -> Column:
    """To the east-first coding; unknown codes become 0."""
    values = {code: EAST_FIRST[step] for code, step in D8.items()}
    return F.coalesce(_lookup(values, pointer.cast("int")), F.lit(0))


def pointer_counts(pointers: DataFrame) -> DataFrame:
    """Cells per pointer code and whether the code is a known one (0 included)."""
    known = F.col("pointer").isin([0, *D8])
    return pointers.groupBy("pointer").agg(F.count("*").alias("cells")).withColumn("expected", known)


def with_next(cells: DataFrame, grid: Grid, within: DataFrame | None = None) -> DataFrame:
    """Adds ``id`` and ``next``; next is NULL off the grid, and off ``within`` when given."""
    dr, dc = pointer_step(F.col("pointer"))
    row, col = F.col("row") + dr, F.col("col") + dc
    inside = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    nxt = F.when(inside, row.cast("long") * grid.width + col)
    out = cells.withColumn("id", cell_id(grid)).withColumn("next", nxt)
    if within is None:
        return out
    ids = within.select(cell_id(grid).alias("next"), F.lit(True).alias("_in")).distinct()
    flowing = out.where("next is not null").join(ids, "next", "left")
    flowing = flowing.withColumn("next", F.when(F.col("_in"), F.col("next"))).drop("_in")
    return flowing.select(out.columns).unionByName(out.where("next is null"))


def flow_accumulation(flow: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(id, row, col, next) -> (row, col, acc): number of cells draining through, itself too."""
    total = accumulate(flow.select("id", "row", "col", "next", F.lit(1.0).alias("w")), grid, tile)
    return _to_cells(total, grid).withColumn("acc", F.round("total").cast("long")).drop("total")


def _to_cells(df: DataFrame, grid: Grid) -> DataFrame:
    rest = [c for c in df.columns if c != "id"]
    return df.select(
        F.expr(f"cast(id div {grid.width} as int)").alias("row"),
        F.expr(f"cast(id % {grid.width} as int)").alias("col"),
        *rest,
    )


def propagate_downstream(flow: DataFrame, seeds: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """Cells that hold a seed or lie downstream of one: seeds are summed along the flow."""
    marks = seeds.select("row", "col").distinct().withColumn("w", F.lit(1.0))
    weighted = flow.select("id", "row", "col", "next").join(marks, ["row", "col"], "left")
    # Both passes over the tiles read it, and the seeds may be a long chain of steps.
    total = accumulate(materialize(weighted.fillna(0.0, ["w"])), grid, tile)
    return _to_cells(total.where("total > 0.5"), grid).select("row", "col")


def min_cells(area_km2: float, cell_area: float) -> int:
    return math.ceil(area_km2 * 1e6 / cell_area)


def min_cells_column(area_km2: Column, cell_area: float) -> Column:
    return F.ceil(area_km2 * 1e6 / cell_area)


def streams(acc: DataFrame, threshold: int | Column, mask: DataFrame | None = None) -> DataFrame:
    s = acc.where(F.col("acc") >= threshold)
    return s if mask is None else s.join(mask.select("row", "col"), ["row", "col"], "left_semi")


def slope_area_seeds(slope: DataFrame, acc: DataFrame, grid: Grid, limit: float = 1e5) -> DataFrame:
    """acc * cell area * (slope in radians + 1e-4)^1.7 above the limit."""
    index = F.col("acc") * grid.cell_area * F.pow(F.radians("slope_deg") + 1e-4, F.lit(1.7))
    joined = slope.select("row", "col", "slope_deg").join(acc, ["row", "col"])
    return joined.withColumn("slope_area", index).where(F.col("slope_area") > limit)


def channel_targets(flow: DataFrame, channels: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, target): first channel cell met downstream, itself included; NULL if there is none."""
    marks = channels.select("row", "col").distinct().withColumn("stop", F.lit(True))
    marked = flow.select("id", "row", "col", "next").join(marks, ["row", "col"], "left")
    return first_downstream(marked.fillna(False, ["stop"]), tile)


def watersheds(flow: DataFrame, pours: DataFrame, grid: Grid, tile: int = TILE, keep_unassigned: bool = False) -> DataFrame:
    """(row, col, outlet): the pour point each cell meets first downstream.

    Cells that meet none are left out, or have a NULL outlet with ``keep_unassigned``.
    """
    targets = channel_targets(flow, pours, tile)
    if not keep_unassigned:
        targets = targets.where("target is not null")
    return _to_cells(targets.withColumnRenamed("target", "outlet"), grid)


def flow_exits(pointers: DataFrame, grid: Grid, mask: DataFrame) -> DataFrame:
    """Mask cells where flow ends: pointer 0, an unknown code, or the next cell off the mask."""
    inside = pointers.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    flow = with_next(inside, grid, within=mask)
    kind = (
        F.when(F.col("pointer") == 0, "pointer_zero")
        .when(~F.col("pointer").isin(list(D8)), "unexpected_pointer")
        .when(F.col("next").isNull(), "boundary_exit")
    )
    return flow.withColumn("kind", kind).where("kind is not null").drop("next")


def rank_exits(exits: DataFrame) -> DataFrame:
    """Dense ids 1.. by accumulation, ties by row and column."""
    return global_rank(exits, [F.desc("acc"), F.asc("row"), F.asc("col")], "outlet_id")


def partition_areas(labels: DataFrame, cell_area: float, label: str = "outlet") -> DataFrame:
    """Cells and area per outlet; NULL stands for cells that reach none."""
    return labels.groupBy(label).agg(
        F.count("*").alias("cells"), (F.count("*") * cell_area / 1e6).alias("area_km2")
    )


def outlet_candidates(
    acc: DataFrame, basin: DataFrame, rivers: DataFrame, grid: Grid, threshold: int, boundary_tol: float, river_tol: float
) -> DataFrame:
    """Stream cells close to the basin boundary and to an official river, with both distances."""
    found = materialize(streams(acc, threshold))
    b = distance.inside_within(found, basin, grid, boundary_tol).withColumnRenamed("dist", "boundary_dist")
    near = materialize(found.join(b, ["row", "col"]))
    r = distance.distance_within(near, rivers, grid, river_tol).withColumnRenamed("dist", "river_dist")
    return near.join(r, ["row", "col"])


def top_by_accumulation(cells: DataFrame, n: int) -> DataFrame:
    return cells.orderBy(F.desc("acc"), "row", "col").limit(n)


def _best_first() -> Column:
    """Ordering key whose maximum is the highest accumulation, then lowest row and column."""
    return F.struct(F.col("acc"), -F.col("row"), -F.col("col"))


def snap_to_maximum(
    starts: DataFrame, acc: DataFrame, grid: Grid, radius: float, key: str = "point_id"
) -> DataFrame:
    """Highest accumulation within the square of +-radius around each start cell."""
    rr = max(1, math.ceil(radius / abs(grid.res_y)))
    rc = max(1, math.ceil(radius / abs(grid.res_x)))
    box = starts.select(
        key,
        F.explode(F.sequence(F.col("row") - rr, F.col("row") + rr)).alias("row"),
        F.col("col").alias("_c"),
    )
    box = box.select(key, "row", F.explode(F.sequence(F.col("_c") - rc, F.col("_c") + rc)).alias("col"))
    best = box.join(acc.select("row", "col", "acc"), ["row", "col"]).groupBy(key).agg(
        F.max_by(F.struct("row", "col", "acc"), _best_first()).alias("_b")
    )
    return best.select(key, "_b.row", "_b.col", "_b.acc")


def outlet_window_audit(
    candidates: DataFrame, boundary_tols: list[float], river_tols: list[float]
) -> DataFrame:
    """Best candidate for every pair of tolerances; pairs without any keep a row of NULLs."""
    spark = candidates.sparkSession
    pairs = spark.createDataFrame(
        [(float(b), float(r)) for b in boundary_tols for r in river_tols],
        "boundary_tol double, river_tol double",
    )
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    hits = candidates.withColumn(
        "boundary_tol", F.explode(F.filter(lits(boundary_tols), lambda t: t >= F.col("boundary_dist")))
    ).withColumn("river_tol", F.explode(F.filter(lits(river_tols), lambda t: t >= F.col("river_dist"))))
    best = hits.groupBy("boundary_tol", "river_tol").agg(
        F.count("*").alias("n"), F.max_by(F.struct("row", "col", "acc"), _best_first()).alias("b")
    )
    return F.broadcast(pairs).join(best, ["boundary_tol", "river_tol"], "left").select(
        "boundary_tol",
        "river_tol",
        F.coalesce("n", F.lit(0)).alias("candidate_cells"),
        F.col("b.row").alias("row"),
        F.col("b.col").alias("col"),
        F.col("b.acc").alias("acc"),
    )


def zone_summary(exits: DataFrame, zone: str = "label", major_km2: float = 0.5) -> DataFrame:
    """Per exit group: area, weighted centre, nearest river, largest accumulation, rank."""
    w = F.greatest(F.coalesce("area_km2", F.lit(0.0)), F.lit(1e-12))
    out = exits.groupBy(zone).agg(
        F.count("*").alias("exit_cells"),
        F.sum(F.coalesce("area_km2", F.lit(0.0))).alias("area_km2"),
        (F.sum(w * F.col("x")) / F.sum(w)).alias("centroid_x"),
        (F.sum(w * F.col("y")) / F.sum(w)).alias("centroid_y"),
        F.min("river_dist").alias("min_river_dist"),
        F.max("acc").alias("max_acc"),
    )
    ranked = global_rank(out, [F.desc("area_km2"), F.asc(zone)], "rank")
    return ranked.withColumn("major", F.col("area_km2") >= major_km2)


def fill_depth_audit(depth: DataFrame, thresholds: list[float], cell_area: float) -> DataFrame:
    """One row: percentiles of the fill depth and cells deeper than each threshold."""
    d = F.col("depth")
    named = {f"cells_gt_{str(t).replace('.', '_')}": F.count_if(d > t) for t in thresholds}
    return group_stats(
        depth,
        [],
        d,
        {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999},
        {
            "valid_cells": F.count(d),
            "area_km2": F.count(d) * cell_area / 1e6,
            "mean_fill": F.avg(d),
            "max_fill": F.max(d),
            **named,
        },
    )


def network_metrics(
    network: DataFrame, grid: Grid, keys: list[str] | None = None, with_components: bool = True
) -> DataFrame:
    """Length, edges, heads, outlets and junctions of a channel mask with pointers, per key."""
    keys = keys or []
    dr, dc = pointer_step(F.col("pointer"))
    w = grid.width
    node = network.select(*keys, "row", "col", cell_id(grid).alias("id"), dr.alias("dr"), dc.alias("dc"))
    row, col = F.col("row") + F.col("dr"), F.col("col") + F.col("dc")
    inside = row.between(0, grid.height - 1) & col.between(0, w - 1)
    node = node.withColumn("next", F.when(inside, row.cast("long") * w + col))
    here = node.select(*keys, "id", F.lit(0).alias("inflow"), F.lit(True).alias("own"), F.lit(0.0).alias("len"))
    size = F.hypot(F.col("dc") * grid.res_x, F.col("dr") * grid.res_y)
    sent = node.where("next is not null").select(
        *keys, F.col("next").alias("id"), F.lit(1).alias("inflow"), F.lit(False).alias("own"), size.alias("len")
    )
    # One grouping per target cell: inflow counts only where the target is itself in the network.
    cells = here.unionByName(sent).groupBy(*keys, "id").agg(
        F.sum("inflow").alias("inflow"), F.max("own").alias("own"), F.sum("len").alias("len")
    )
    own = cells.where("own")
    g = own.groupBy(*keys) if keys else own
    out = g.agg(
        F.count("*").alias("stream_cells"),
        F.sum("inflow").alias("edges"),
        (F.sum("len") / 1000.0).alias("length_km"),
        F.count_if(F.col("inflow") == 0).alias("heads"),
        (F.count("*") - F.sum("inflow")).alias("outlets"),
        F.count_if(F.col("inflow") >= 2).alias("junctions"),
    )
    if not with_components:
        return out
    sizes = label_components(network, grid, keys).groupBy(*keys, "label").agg(F.count("*").alias("n"))
    gs = sizes.groupBy(*keys) if keys else sizes
    comp = gs.agg(F.count("*").alias("components"), F.max("n").alias("largest_cells"))
    both = out.join(comp, keys) if keys else out.withColumn("_k", F.lit(0)).join(
        comp.withColumn("_k", F.lit(0)), "_k"
    ).drop("_k")
    return both.withColumn("largest_fraction", F.try_divide(F.col("largest_cells"), F.col("stream_cells")))


def proximity_agreement(
    model: DataFrame, official: DataFrame, grid: Grid, tolerances: list[float], key: str | None = None, key_values: list | None = None
) -> DataFrame:
    """Shares of model cells near the official lines and back, F1 and F2 per key and tolerance.

    Distances are searched up to the largest tolerance from the cells of both sides only. Every key
    value and tolerance has a row; an empty side gives 0.
    """
    spark = model.sparkSession
    keys = [key] if key else []
    reach = float(max(tolerances))
    m = materialize(model.select(*keys, "row", "col").distinct())
    o = official.select("row", "col").distinct()
    asked = o
    if key:
        kind = model.schema[key].dataType
        each = F.explode(F.array(*[F.lit(k).cast(kind) for k in key_values])).alias(key)
        asked = o.select(each, "row", "col")
    asked = materialize(asked)
    to_official = m.join(distance.distance_within(m, o, grid, reach), ["row", "col"], "left")
    to_model = asked.join(distance.distance_within(asked, m, grid, reach, keys), [*keys, "row", "col"], "left")
    tol = F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tolerance")
    near = F.count_if(F.col("dist") <= F.col("tolerance"))

    def share(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, "dist", tol).groupBy(*keys, "tolerance").agg((near / F.count("*")).alias(name))

    # Two lists of fixed length.
    every = spark.range(1).select(each) if key else spark.range(1)
    every = every.select(*keys, tol)
    both = every.join(share(to_official, "precision_like"), [*keys, "tolerance"], "left").join(share(to_model, "recall_like"), [*keys, "tolerance"], "left")
    p, r = F.coalesce("precision_like", F.lit(0.0)), F.coalesce("recall_like", F.lit(0.0))
    both = both.select(*keys, "tolerance", p.alias("precision_like"), r.alias("recall_like"))
    p, r = F.col("precision_like"), F.col("recall_like")
    return both.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))).withColumn(
        "f2", F.when(4 * p + r == 0, 0.0).otherwise(5 * p * r / (4 * p + r))
    )


def sweep_leaders(sweep: DataFrame, by: str = "area_km2") -> DataFrame:
    """Best F1, best F2 and closest length per tolerance; the first candidate wins ties."""
    first = -F.col(by)
    return sweep.groupBy("tolerance").agg(
        F.max_by(F.col(by), F.struct("f1", first)).alias("best_f1"),
        F.max_by(F.col(by), F.struct("f2", first)).alias("best_f2"),
        F.min_by(F.col(by), F.struct("length_gap", F.col(by))).alias("closest_length"),
    )


# Boxes with at most so many pairs of points between them are compared point by point.
FEW_PAIRS = 64


def _squares_in_reach(spots: DataFrame, side: float, radius: float, few: int) -> DataFrame:
    """(bx0, by0, bx, by): neighbouring squares that hold a pair of points within the radius.

    The points of a square have a box. Two boxes are in reach if their farthest corners or their first points
    are, and out of reach if their nearest corners are not. What is undecided is cut in four on both
    sides and looked at again, until few points are left; a pair of squares ends at its first meeting.
    Only boxes about a radius apart go on, so the work is near linear in the points.
    """
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around]))
    held = spots.select("bx", "by").distinct()
    pairs = held.select(F.col("bx").alias("bx0"), F.col("by").alias("by0"), shift.alias("s"))
    pairs = pairs.select("bx0", "by0", (F.col("bx0") + F.col("s.i")).alias("bx"), (F.col("by0") + F.col("s.j")).alias("by"))
    top = ["bx0", "by0", "bx", "by"]
    open_pairs = materialize(pairs.join(held, ["bx", "by"]).select(*top, *[F.lit(0).cast("long").alias(c) for c in ("ux", "uy", "vx", "vy")]))
    found, level = None, 0
    while not open_pairs.isEmpty():
        part = lambda c, b: F.floor((F.col(c) / side - F.col(b)) * float(2**level)).cast("long")
        busy = open_pairs.select("bx", "by").union(open_pairs.select("bx0", "by0")).distinct()
        cut = spots.join(busy, ["bx", "by"], "left_semi").select("bx", "by", part("x", "bx").alias("sx"), part("y", "by").alias("sy"), "x", "y")
        boxes = materialize(
            cut.groupBy("bx", "by", "sx", "sy").agg(
                F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.struct("x", "y")).alias("p"), F.count("*").alias("n")
            )
        )
        box = F.struct("x0", "x1", "y0", "y1", "p", "n")
        left = boxes.select(F.col("bx").alias("bx0"), F.col("by").alias("by0"), F.col("sx").alias("ux"), F.col("sy").alias("uy"), box.alias("l"))
        right = boxes.select("bx", "by", F.col("sx").alias("vx"), F.col("sy").alias("vy"), box.alias("r"))
        met = open_pairs.join(left, ["bx0", "by0", "ux", "uy"]).join(right, ["bx", "by", "vx", "vy"])

        def gap(lo: str, hi: str) -> Column:
            return F.greatest(F.lit(0.0), F.col(f"r.{lo}") - F.col(f"l.{hi}"), F.col(f"l.{lo}") - F.col(f"r.{hi}"))

        def span(lo: str, hi: str) -> Column:
            return F.greatest(F.abs(F.col(f"r.{hi}") - F.col(f"l.{lo}")), F.abs(F.col(f"l.{hi}") - F.col(f"r.{lo}")))

        first = F.hypot(F.col("r.p.x") - F.col("l.p.x"), F.col("r.p.y") - F.col("l.p.y")) <= radius
        judged = met.where(F.hypot(gap("x0", "x1"), gap("y0", "y1")) <= radius).select(
            *top, "ux", "uy", "vx", "vy", (first | (F.hypot(span("x0", "x1"), span("y0", "y1")) <= radius)).alias("near"), (F.col("l.n") * F.col("r.n") <= few).alias("few")
        )
        judged = materialize(judged)
        near = judged.where("near").select(*top)
        a = cut.select(F.col("bx").alias("bx0"), F.col("by").alias("by0"), F.col("sx").alias("ux"), F.col("sy").alias("uy"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = cut.select("bx", "by", F.col("sx").alias("vx"), F.col("sy").alias("vy"), "x", "y")
        by_points = judged.where("few AND NOT near").join(a, ["bx0", "by0", "ux", "uy"]).join(b, ["bx", "by", "vx", "vy"])
        by_points = by_points.where(F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")) <= radius).select(*top)
        now = materialize(near.unionByName(by_points).distinct())
        found = now if found is None else found.unionByName(now)
        halves = [F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias(c) for c in ("_a", "_b", "_c", "_d")]
        left_over = judged.where("NOT near AND NOT few").join(now, top, "left_anti")
        for h in halves:
            left_over = left_over.select("*", h)
        open_pairs = materialize(
            left_over.select(*top, *[(2 * F.col(c) + F.col(h)).alias(c) for c, h in (("ux", "_a"), ("uy", "_b"), ("vx", "_c"), ("vy", "_d"))])
        )
        level += 1
    return found.distinct() if found is not None else pairs.limit(0)


def exit_clusters(exits: DataFrame, radius: float, few: int = FEW_PAIRS) -> DataFrame:
    """(point_id, label): points chained by steps of at most ``radius``.

    Buckets of side radius / sqrt(2): all points of a bucket belong together, so they are tied
    to the smallest id of the bucket instead of to each other. Whether buckets next to one another hold a pair in
    reach is decided by boxes, so dense buckets are not compared point by point.
    """
    side = radius / math.sqrt(2.0) * (1 - 1e-9)
    pts = exits.select(
        "point_id", "x", "y", F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by")
    )
    heads = pts.groupBy("bx", "by").agg(F.min("point_id").alias("head"))
    spots = materialize(pts.select("bx", "by", "x", "y").distinct())
    linked = _squares_in_reach(spots, side, radius, few)
    a = heads.select(F.col("bx").alias("bx0"), F.col("by").alias("by0"), F.col("head").alias("a"))
    b = heads.withColumnRenamed("head", "b")
    merged = components(linked.join(a, ["bx0", "by0"]).join(b, ["bx", "by"]).select("a", "b")).select(F.col("node").alias("head"), "label")
    home = pts.select("point_id", "bx", "by").join(heads, ["bx", "by"])
    return home.join(merged, "head", "left").select("point_id", F.coalesce("label", "head").alias("label"))


def exit_points(exits: DataFrame, grid: Grid) -> DataFrame:
    x, y = cell_xy(grid)
    return exits.withColumn("x", x).withColumn("y", y)


