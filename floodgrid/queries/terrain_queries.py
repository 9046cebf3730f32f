"""Depression handling, outlines and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgrid.functions.rounding import rounded
from floodgrid.operators import conditioning, distance, focal, hydro, outline, resample
from floodgrid.operators.grid import Grid, valid_cells
from floodgrid.operators.tilegraph import label_components
from floodgrid.plans.conditioning_study import conditioning_scenarios
from floodgrid.queries import fixtures as fx
from floodgrid.queries.flow_queries import LABELS
from floodgrid.queries.registry import query
from floodgrid.queries.sqlparts import sql


FILL = """WITH RECURSIVE n8 AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.z AS z FROM g a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dr,dc) JOIN g b ON b.row=a.row+s.dr AND b.col=a.col+s.dc),
    f(id, w) USING KEY (id) AS (SELECT g.id, g.z AS w FROM g, h WHERE row IN (0, h.hi-1) OR col IN (0,99) UNION
      SELECT n.b, min(greatest(n.z, f.w)) FROM f JOIN n8 n ON n.a=f.id LEFT JOIN recurring.f o ON o.id=n.b WHERE o.w IS NULL OR greatest(n.z, f.w) < o.w GROUP BY n.b)
    SELECT g.row, g.col, round(g.z,6) AS value, round(f.w,6) AS filled FROM g JOIN f ON f.id=g.id"""


@query(FILL.replace("WITH RECURSIVE", sql("SELECT 1 FROM g, h").rsplit("\n", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1) + ","))
def depression_filling(spark, sf):
    return rounded(conditioning.fill_depressions(fx.dem(spark, sf), fx.grid(spark, sf)))


@query(sql("""SELECT count(*) AS cells, 0::BIGINT AS lowered_cells, 0::BIGINT AS inner_pits FROM g"""))
def filling_invariants(spark, sf):
    """Filling never lowers a cell and leaves none without a way down or level but the border."""
    g = fx.grid(spark, sf)
    f = fx.materialize(conditioning.fill_depressions(fx.dem(spark, sf), g))
    flow = hydro.with_next(
        conditioning.route_flats(hydro.d8_pointer(f.select("row", "col", F.col("filled").alias("value")), g), g), g
    )
    border = F.col("row").isin(0, g.height - 1) | F.col("col").isin(0, g.width - 1)
    pits = flow.where(F.col("next").isNull() & ~border).agg(F.count("*")).scalar()
    out = f.agg(F.count("*").alias("cells"), F.count_if(F.col("filled") < F.col("value")).alias("lowered_cells"))
    return out.withColumn("inner_pits", pits)


@query()
def depression_breaching(spark, sf):
    return rounded(conditioning.breach_then_fill(fx.dem(spark, sf), fx.grid(spark, sf), 10))


@query(sql("""SELECT count(*) AS cells, count(*) FILTER (n=8 AND lower_=0) AS pits, count(*) FILTER (n=8 AND lower_=0 AND z < lowest_ring) AS closed_pits, 0::BIGINT AS raised_cells, 0::BIGINT AS far_cells FROM np""",
    np="""SELECT a.id, a.z, count(b.id) AS n, count(*) FILTER (b.z < a.z) AS lower_, min(b.z) AS lowest_ring FROM g a
        JOIN g b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND b.id<>a.id GROUP BY 1,2"""))
def breaching_invariants(spark, sf):
    """Carving never raises a cell and changes none beyond its reach from a pit."""
    g, dist = fx.grid(spark, sf), 10
    dem = fx.dem(spark, sf)
    around = focal.neighbourhood(dem, "value")
    inner, lowest = ~F.exists("nb", lambda x: x.isNull()), ~F.exists("nb", lambda x: x < F.col("value"))
    closed = F.size(F.filter("nb", lambda x: x == F.col("value"))) == 1
    pits = fx.materialize(around.where(inner & lowest).select("row", "col", closed.alias("closed")))
    cut = fx.materialize(conditioning.breach_depressions(dem, g, dist))
    changed = cut.where("breached <> value").select("row", "col")
    near = distance.square_reach(changed, pits, dist)
    far = changed.join(near, ["row", "col"], "left_anti").agg(F.count("*")).scalar()
    out = cut.agg(F.count("*").alias("cells"), F.count_if(F.col("breached") > F.col("value")).alias("raised_cells"))
    counts = pits.agg(F.count("*").alias("pits"), F.count_if("closed").alias("closed_pits"))
    return out.withColumns({c: counts.select(c).scalar() for c in counts.columns}).withColumn("far_cells", far)


@query(sql("""SELECT count(*) AS pits_in_reach, 0::BIGINT AS stuck_pits, 0::BIGINT AS carved_pits FROM np p WHERE n=8 AND lower_=0
    AND EXISTS (SELECT 1 FROM g b WHERE b.row BETWEEN p.row-10 AND p.row+10 AND b.col BETWEEN p.col-10 AND p.col+10 AND b.z < p.z)""",
    np="""SELECT a.id, a.row, a.col, a.z, count(b.id) AS n, count(*) FILTER (b.z < a.z) AS lower_ FROM g a
        JOIN g b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND b.id<>a.id GROUP BY 1,2,3,4"""))
def breaching_ways_out(spark, sf):
    """Every pit with lower ground in reach has a way down on the breached surface, and so has every carved cell.

    Both together give each such pit a descending way through carved cells to ground that was lower
    at the start. The table has no gaps, so all ground of a pit's square is in its reach.
    """
    g, dist = fx.grid(spark, sf), 10
    dem = fx.dem(spark, sf)
    cut = fx.materialize(conditioning.breach_depressions(dem, g, dist))
    around = focal.neighbourhood(dem, "value")
    inner, lowest = ~F.exists("nb", lambda x: x.isNull()), ~F.exists("nb", lambda x: x < F.col("value"))
    pits = fx.materialize(around.where(inner & lowest).select("row", "col", "value"))
    span = lambda c: F.explode(F.sequence(F.col(c) - dist, F.col(c) + dist))
    square = pits.select(F.col("row").alias("prow"), F.col("col").alias("pcol"), F.col("value").alias("top"), span("row").alias("row"))
    square = square.select("*", span("pcol").alias("col"))
    lower = square.join(dem.select("row", "col", "value"), ["row", "col"]).where("value < top")
    reach = fx.materialize(lower.select(F.col("prow").alias("row"), F.col("pcol").alias("col")).distinct())
    after = focal.neighbourhood(cut.select("row", "col", F.col("breached").alias("value")), "value")
    down = fx.materialize(after.where(F.exists("nb", lambda x: F.coalesce(x < F.col("value"), F.lit(False)))).select("row", "col"))
    stuck = reach.join(down, ["row", "col"], "left_anti").agg(F.count("*")).scalar()
    carved = cut.where("breached < value").join(down, ["row", "col"], "left_anti").agg(F.count("*")).scalar()
    return reach.agg(F.count("*").alias("pits_in_reach")).withColumns({"stuck_pits": stuck, "carved_pits": carved})


@query()
def conditioning_comparison(spark, sf):
    return rounded(
        conditioning_scenarios(fx.dem(spark, sf), fx.grid(spark, sf), [5, 10], fx.basin(spark, sf), fx.river_cells(spark, sf), 100, 5.0)
    )


OUT = {
    "sides": "SELECT m.id, lab.label, s.dr, s.dc, m.row, m.col FROM m JOIN lab ON lab.id=m.id, (VALUES (-1,0),(0,1),(1,0),(0,-1)) s(dr,dc)",
    "open_": "SELECT s.label, count(*) AS n FROM sides s LEFT JOIN m b ON b.row=s.row+s.dr AND b.col=s.col+s.dc WHERE b.id IS NULL GROUP BY 1",
}


@query(sql("SELECT o.label, l.cells*1e0 AS area, o.n AS perimeter FROM open_ o JOIN labs l ON l.label=o.label", **LABELS, **OUT))
def mask_outlines(spark, sf):
    g = fx.grid(spark, sf)
    rings = outline.outline_rings(fx.materialize(label_components(fx.observed(spark, sf), g)), g)
    return outline.ring_measures(rings).select("label", "area", "perimeter")


PARTS4 = {
    "adj4": """SELECT a.id AS a, b.id AS b FROM m a, (VALUES (-1,0),(0,-1),(0,1),(1,0)) s(dr,dc)
        JOIN m b ON b.row=a.row+s.dr AND b.col=a.col+s.dc""",
    "reach4": "SELECT id AS src, id AS node FROM m UNION SELECT r.src, adj4.b FROM reach4 r JOIN adj4 ON adj4.a=r.node",
    "part": "SELECT node AS id, min(src) AS part FROM reach4 GROUP BY node",
    "cnr": """SELECT part.part, m.row+dr AS r, m.col+dc AS c, count(*) AS n, count(*)=2 AND sum(dr)=1 AND sum(dc)=1 AS cross_
        FROM m JOIN part ON part.id=m.id, (VALUES (0,0),(0,1),(1,0),(1,1)) s(dr,dc) GROUP BY 1,2,3""",
    "turns": "SELECT part, r, c, CASE WHEN cross_ THEN 2 WHEN n IN (1,3) THEN 1 END AS times, CASE WHEN cross_ THEN -2 WHEN n=1 THEN -1 WHEN n=3 THEN 1 END AS bend FROM cnr WHERE cross_ OR n IN (1,3)",
}


@query(sql("SELECT part, c*1e0 AS x, r*1e0 AS y, times FROM turns", **LABELS, **PARTS4))
def mask_polygon_vertices(spark, sf):
    """Corners of the polygons of the observed cells; where a part touches itself the corner counts twice."""
    g = fx.grid(spark, sf)
    pieces = outline.polygon_pieces(fx.materialize(label_components(fx.observed(spark, sf), g)), g, piece=8, tile=16)
    v = pieces.select("part", F.explode("vertices").alias("v")).groupBy("part", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return v.agg(F.count("*").cast("int").alias("times"))


@query(sql("""SELECT lab.label, t.part, t.part*4 AS shell, CAST(1 + sum(bend)/4 AS BIGINT) AS holes, CAST(sum(times) AS BIGINT) AS vertices
    FROM turns t JOIN lab ON lab.id=t.part GROUP BY 1,2""", **LABELS, **PARTS4))
def mask_polygon_holes(spark, sf):
    """Polygons of the observed cells with the number of holes that belong to each shell."""
    g = fx.grid(spark, sf)
    pieces = outline.polygon_pieces(fx.materialize(label_components(fx.observed(spark, sf), g)), g)
    holes = F.count_distinct(F.when(F.col("hole"), F.col("ring"))).alias("holes")
    return pieces.groupBy("label", "part", "shell").agg(holes, F.sum(F.size("vertices")).alias("vertices"))


RES = {
    "tg": "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, (c+5e-1)*7e-1 AS x, (r+5e-1)*7e-1 AS y FROM (SELECT unnest(range(CAST(floor(h/7e-1) AS BIGINT))) AS r FROM h) a, (SELECT unnest(range(142)) AS c) b",
    "sv": "SELECT * FROM gn WHERE z <> -9999",
    "four": """SELECT t.row, t.col, CAST(floor(y-5e-1) AS INT)+i AS r, CAST(floor(x-5e-1) AS INT)+j AS c, (CASE i WHEN 1 THEN (y-5e-1)-floor(y-5e-1) ELSE 1e0-((y-5e-1)-floor(y-5e-1)) END)*
        (CASE j WHEN 1 THEN (x-5e-1)-floor(x-5e-1) ELSE 1e0-((x-5e-1)-floor(x-5e-1)) END) AS w FROM tg t, (SELECT unnest([0,1]) AS i) a, (SELECT unnest([0,1]) AS j) b""",
}


def _target(spark, sf):
    h = fx.grid(spark, sf).height
    return Grid(142, int(h / 0.7), 0.0, 0.0, 0.7, 0.7)


@query(sql("SELECT f.row, f.col, round(sum(w*z)/sum(w),6) AS value FROM four f JOIN sv s ON s.row=f.r AND s.col=f.c WHERE w>0 GROUP BY 1,2", **RES))
def resample_bilinear(spark, sf):
    cells = valid_cells(fx.dem_nodata(spark, sf))
    return rounded(resample.resample_bilinear(cells, fx.grid(spark, sf), _target(spark, sf)))


@query(sql("SELECT t.row, t.col, round(z,6) AS value FROM tg t JOIN sv s ON s.row=CAST(floor(y) AS INT) AND s.col=CAST(floor(x) AS INT)", **RES))
def resample_nearest(spark, sf):
    cells = valid_cells(fx.dem_nodata(spark, sf))
    return rounded(resample.resample_nearest(cells, fx.grid(spark, sf), _target(spark, sf)))


@query(sql("SELECT zc.k, g.row, g.col, zc.k AS source_layer FROM zc JOIN basin b ON b.id=zc.id JOIN g ON g.id=zc.id"))
def clip_polygons_to_region(spark, sf):
    """Polygon features clipped to the basin, as cells, with the tag of their source."""
    z = fx.zone_cells(spark, sf).join(fx.basin(spark, sf), ["row", "col"], "left_semi")
    return z.select("k", "row", "col", F.col("k").alias("source_layer"))
