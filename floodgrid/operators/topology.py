"""Ring nesting, geometry validity, and clipping of lines and polygons to regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.operators.polygon_overlay import judge_seeds, judged_chains, meeting_boxes
from floodgrid.operators.polygon_overlay import ring_edges as edges_in_order
from floodgrid.operators.vector import edges as make_edges
from floodgrid.runtime import materialize


def ring_table(features: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, ring_id, ring)"""
    return features.select(key, F.posexplode(rings).alias("ring_id", "ring"))


def ring_edges(ring_rows: DataFrame, key: str) -> DataFrame:
    r = ring_rows.select(key, "ring_id", F.array(F.array("ring")).alias("coords"))
    return make_edges(r, [key, "ring_id"]).drop("part", "ring")


def nest_rings(features: DataFrame, key: str, band: float, rings: str = "rings") -> DataFrame:
    """(key, ring_id, area, depth, parent, role): shells and holes from nesting, not orientation.

    A ring lies in another when the mid-point of its first edge does and the other is larger.
    Mid-points meet only edges of the same horizontal band of height ``band``, so rings that are
    apart are never paired.
    """
    e = ring_edges(ring_table(features, key, rings), key)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    area = e.groupBy(key, "ring_id").agg(
        F.abs(F.sum(cross) / 2).alias("area"),
        F.min_by(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")), "seq").alias("p"),
    )
    span = F.sequence(
        F.floor(F.least("y1", "y2") / band).cast("long"), F.floor(F.greatest("y1", "y2") / band).cast("long")
    )
    outer = e.where("y1 != y2").select(key, F.col("ring_id").alias("other"), "x1", "y1", "x2", "y2", F.explode(span).alias("_b"))
    probe = area.select(key, "ring_id", "area", F.col("p.x").alias("x"), F.col("p.y").alias("y")).withColumn("_b", F.floor(F.col("y") / band))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    spans = (F.col("y") >= F.least("y1", "y2")) & (F.col("y") < F.greatest("y1", "y2")) & (at > F.col("x"))
    hits = probe.join(outer, [key, "_b"]).where((F.col("ring_id") != F.col("other")) & spans)
    inside = hits.groupBy(key, "ring_id", "other").agg(F.count("*").alias("n")).where("n % 2 = 1")
    sizes = area.select(key, F.col("ring_id").alias("other"), F.col("area").alias("other_area"))
    own = area.select(key, "ring_id", "area")
    holders = inside.join(sizes, [key, "other"]).join(own, [key, "ring_id"]).where("other_area > area")
    up = holders.groupBy(key, "ring_id").agg(
        F.count("*").alias("depth"), F.min_by("other", F.struct("other_area", "other")).alias("parent")
    )
    out = own.join(up, [key, "ring_id"], "left").fillna(0, ["depth"])
    return out.withColumn("role", F.when(F.col("depth") % 2 == 0, "shell").otherwise("hole"))


def nested_area(nesting: DataFrame, key: str) -> DataFrame:
    """Shell and hole counts and the area of each feature."""
    sign = F.when(F.col("role") == "shell", F.col("area")).otherwise(-F.col("area"))
    return nesting.groupBy(key).agg(
        F.count_if(F.col("role") == "shell").alias("shells"), F.count_if(F.col("role") == "hole").alias("holes"), F.sum(sign).alias("area")
    )


def grouped_parts(nesting: DataFrame, ring_rows: DataFrame, key: str) -> DataFrame:
    """(key, parts): each shell followed by its holes, as polygon coordinates."""
    r = nesting.join(ring_rows, [key, "ring_id"])
    home = F.when(F.col("role") == "shell", F.col("ring_id")).otherwise(F.col("parent"))
    poly = r.withColumn("_home", home).groupBy(key, "_home").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((F.col("role") == "hole").alias("h"), "ring_id", "ring"))), lambda x: x["ring"]).alias("rings")
    )
    return poly.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_home", "rings"))), lambda x: x["rings"]).alias("parts"))


def validity_report(features: DataFrame, key: str, cell: float, rings: str = "rings") -> DataFrame:
    """(key, issue) for null geometries, short or open rings, bad coordinates and self-crossings."""
    null = features.where(F.col(rings).isNull() | (F.size(rings) == 0)).select(key, F.lit("null geometry").alias("issue"))
    r = ring_table(features.where(F.col(rings).isNotNull()), key, rings)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bad = F.exists("ring", lambda p: (F.size(p) < 2) | ~finite(F.get(p, F.lit(0))) | ~finite(F.get(p, F.lit(1))))
    first, last = F.col("ring")[0], F.element_at("ring", -1)
    opened = (first[0] != last[0]) | (first[1] != last[1])
    kinds = F.array_compact(
        F.array(
            F.when(F.size("ring") < 4, "fewer than 4 points"),
            F.when((F.size("ring") > 0) & F.coalesce(opened, F.lit(False)), "unclosed ring"),
            F.when(bad, "bad coordinate"),
        )
    )
    shape = r.select(key, F.explode(kinds).alias("issue"))
    crossing = self_crossings(ring_edges(r.where(~bad), key), key, cell).select(key, F.lit("self-crossing").alias("issue"))
    return null.unionByName(shape).unionByName(crossing).distinct()


def self_crossings(edge_rows: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, ring_id) of rings with two edges that properly cross; only edges of a bucket meet."""
    bx = F.sequence(F.floor(F.least("x1", "x2") / cell).cast("long"), F.floor(F.greatest("x1", "x2") / cell).cast("long"))
    by = F.sequence(F.floor(F.least("y1", "y2") / cell).cast("long"), F.floor(F.greatest("y1", "y2") / cell).cast("long"))
    e = edge_rows.select("*", F.explode(bx).alias("_bx")).select("*", F.explode(by).alias("_by"))
    other = e.select(
        key, "ring_id", "_bx", "_by", F.col("seq").alias("seq2"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2")
    )
    turn = lambda ax, ay, bx_, by_, cx, cy: (F.col(bx_) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by_) - F.col(ay)) * (F.col(cx) - F.col(ax))
    a = turn("x1", "y1", "x2", "y2", "u1", "v1") * turn("x1", "y1", "x2", "y2", "u2", "v2") < 0
    b = turn("u1", "v1", "u2", "v2", "x1", "y1") * turn("u1", "v1", "u2", "v2", "x2", "y2") < 0
    return e.join(other, [key, "ring_id", "_bx", "_by"]).where((F.col("seq") < F.col("seq2")) & a & b).select(key, "ring_id").distinct()


def _lines(line_edges: DataFrame, line_key: str) -> DataFrame:
    """Edges of lines in order; lines are open and have one part."""
    one = line_edges.select(line_key, F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", "x1", "y1", "x2", "y2")
    return edges_in_order(one, line_key, oriented=False)


def clip_lines(line_boxes: DataFrame, line_edges: DataFrame, region_boxes: DataFrame, region_edges: DataFrame, line_key: str, region_key: str, cell: float) -> DataFrame:
    """(line, region, seq, piece, x1, y1, x2, y2): the parts of lines inside polygons.

    Lines are cut at every crossing with the polygon's edges; a chain between two cuts is kept when its
    seed point is inside. Only kept chains are written edge by edge. Boxes find the candidate pairs.
    """
    own = _lines(line_edges, line_key)
    pairs = materialize(meeting_boxes(line_boxes, region_boxes, [line_key], [region_key]))
    kept = judged_chains(own, region_edges, line_key, region_key, cell, pairs, closed=False).where("odd")
    # A chain that ends at the start of an edge has no part of that edge.
    last = F.when(F.col("t2") > 0, F.col("seq2")).otherwise(F.col("seq2") - 1)
    span = kept.select(line_key, region_key, F.col("seq").alias("s1"), "t", "seq2", "t2", F.explode(F.sequence(F.col("seq"), last)).alias("seq"))
    whole = span.join(own.select(line_key, "seq", "x1", "y1", "x2", "y2"), [line_key, "seq"])
    t = F.when(F.col("seq") == F.col("s1"), F.col("t")).otherwise(0.0)
    t2 = F.when(F.col("seq") == F.col("seq2"), F.col("t2")).otherwise(1.0)
    at = lambda a, b, w: F.col(a) + (F.col(b) - F.col(a)) * w
    return whole.select(
        line_key, region_key, "seq", t.alias("piece"),
        at("x1", "x2", t).alias("x1"), at("y1", "y2", t).alias("y1"), at("x1", "x2", t2).alias("x2"), at("y1", "y2", t2).alias("y2"),
    )


def features_in_region(line_boxes: DataFrame, line_edges: DataFrame, region_boxes: DataFrame, region_edges: DataFrame, line_key: str, region_key: str, cell: float) -> DataFrame:
    """(line, region) pairs of which a part of the line lies inside.

    A pair is taken at its first meeting: the lines whose first point is inside are found by one seed point each,
    and only the pairs that are left are searched for a chain inside. No line is clipped.
    """
    own = _lines(line_edges, line_key)
    pairs = materialize(meeting_boxes(line_boxes, region_boxes, [line_key], [region_key]))
    start = own.where("seq = 0").select(line_key, F.col("x1").alias("sx"), F.col("y1").alias("sy"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    first = judge_seeds(pairs.join(start, line_key), region_edges, [line_key, region_key], region_key, cell)
    met = materialize(first.where("odd AND NOT on").select(line_key, region_key))
    left = materialize(pairs.join(met, [line_key, region_key], "left_anti"))
    others = judged_chains(own, region_edges, line_key, region_key, cell, left, closed=False).where("odd AND NOT on")
    return met.unionByName(others.select(line_key, region_key).distinct())


def tag_layer(features: DataFrame, layer: int | Column) -> DataFrame:
    return features.withColumn("source_layer", layer if isinstance(layer, Column) else F.lit(layer))
