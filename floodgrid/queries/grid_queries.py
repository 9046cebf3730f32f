"""Raster cells: sources, statistics, tiling, overviews, focal operators, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgrid.functions.rounding import rounded
from floodgrid.operators import focal, grid as gr, masks, vector
from floodgrid.operators.distance import buffer_cells
from floodgrid.queries import fixtures as fx
from floodgrid.queries.registry import query
from floodgrid.queries.sqlparts import sql

Q = "quantile_cont"


@query(sql("SELECT row, col, round(z,6) AS value FROM gn WHERE z <> -9999"))
def raster_cell_source(spark, sf):
    return rounded(gr.valid_cells(fx.dem_nodata(spark, sf)))


@query(sql("""SELECT count(*) AS total_cells, count(*) FILTER (z >= 2e0 AND z <= 2e1) AS valid_cells,
    count(*) FILTER (NOT (z >= 2e0 AND z <= 2e1)) AS invalid_cells FROM gn"""))
def raster_range_cleaning(spark, sf):
    return gr.cleaning_report(gr.clean_range(fx.dem_nodata(spark, sf), 2.0, 20.0))


@query(sql(f"""SELECT count(*) AS cells, round(min(z),6) AS min_value, round(avg(z),6) AS mean_value, round(max(z),6) AS max_value,
    round({Q}(z,0.01),6) AS p01, round({Q}(z,0.5),6) AS median, round({Q}(z,0.99),6) AS p99 FROM gn WHERE z <> -9999"""))
def raster_profile(spark, sf):
    return rounded(gr.profile(gr.valid_cells(fx.dem_nodata(spark, sf))))


@query(sql("SELECT floor(z) AS value, count(*) AS cells FROM g GROUP BY 1 ORDER BY cells DESC, value LIMIT 10"))
def raster_common_values(spark, sf):
    return gr.top_values(fx.dem(spark, sf).withColumn("value", F.floor("value").cast("double")))


@query(sql("""SELECT 2 AS rasters, same AS same_width, same2 AS same_height, same AND same2 AS aligned FROM
    (SELECT (SELECT max(col)+1 FROM g) = (SELECT max(col)+1 FROM gn WHERE z<>-9999) AS same,
            (SELECT max(row)+1 FROM g) = (SELECT max(row) FROM gn WHERE z<>-9999) AS same2)"""))
def raster_alignment(spark, sf):
    """Geometry of the raster against one that lacks its last row."""

    def meta(cells, extra):
        return cells.agg(
            F.lit("EPSG:32747").alias("crs"), (F.max("col") + 1).alias("width"), (F.max("row") + extra).alias("height")
        ).withColumns({f: F.lit(1.0) for f in ("res_x", "res_y", "origin_x", "origin_y")})

    both = meta(fx.dem(spark, sf), 1).unionByName(meta(gr.valid_cells(fx.dem_nodata(spark, sf)), 0))
    out = gr.alignment_report(both)
    return out.select(F.col("rasters").cast("int").alias("rasters"), "same_width", "same_height", "aligned")


@query("""SELECT floor(min(c_acctbal)/5e1)*5e1 AS xmin, floor(min(c_custkey)/7e0*1e0/5e1)*5e1 AS ymin, ceil(max(c_acctbal)/5e1)*5e1 AS xmax,
    ceil(max(c_custkey/7e0)/5e1)*5e1 AS ymax,
    CAST(round((ceil(max(c_acctbal)/5e1)*5e1-floor(min(c_acctbal)/5e1)*5e1)/5e1) AS BIGINT) AS width,
    CAST(round((ceil(max(c_custkey/7e0)/5e1)*5e1-floor(min(c_custkey/7e0)/5e1)*5e1)/5e1) AS BIGINT) AS height FROM customer""")
def extent_snapped_to_grid(spark, sf):
    x, y = F.col("c_acctbal"), F.col("c_custkey") / 7.0
    boxes = fx.table(spark, sf, "customer").select(
        x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax")
    )
    return gr.snap_extent(boxes, 50.0)


@query("""WITH s AS (SELECT o_custkey AS raster, count(*)*9 AS width, CAST(max(o_totalprice)/1e3 AS BIGINT) AS height FROM orders GROUP BY 1)
    SELECT raster, r//60 AS tile_row, c//40 AS tile_col, r AS row0, c AS col0, least(40, width-c) AS tile_width, least(60, height-r) AS tile_height
    FROM (SELECT raster, width, height, unnest(range(0, height, 60)) AS r FROM s) t, LATERAL (SELECT unnest(range(0, t.width, 40)) AS c)""")
def tile_plan_with_edges(spark, sf):
    sizes = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("raster")).agg(
        (F.count("*") * 9).alias("width"), F.round(F.max("o_totalprice") / 1e3).cast("long").alias("height")
    )
    return gr.tile_plan(sizes, 40, 60)


@query("""SELECT s_suppkey AS box, i AS part_row, j AS part_col, round(s_acctbal+(s_suppkey+10e0)/4e0*j,6) AS xmin, round(s_nationkey+3e0/3e0*i,6) AS ymin,
    round(s_acctbal+(s_suppkey+10e0)/4e0*(j+1),6) AS xmax, round(s_nationkey+3e0/3e0*(i+1),6) AS ymax
    FROM supplier, (SELECT CAST(unnest(range(3)) AS INT) AS i), (SELECT CAST(unnest(range(4)) AS INT) AS j)""")
def bbox_even_split(spark, sf):
    boxes = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("box"),
        F.col("s_acctbal").alias("xmin"),
        F.col("s_nationkey").cast("double").alias("ymin"),
        (F.col("s_acctbal") + F.col("s_suppkey") + 10.0).alias("xmax"),
        (F.col("s_nationkey") + 3.0).alias("ymax"),
    )
    return rounded(gr.split_bbox(boxes, 4, 3))


@query(sql("""SELECT t.tile_row, t.tile_col, z.k FROM (SELECT DISTINCT row//20 AS tile_row, col//20 AS tile_col FROM g) t
    JOIN (SELECT k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nverts WHERE ring=0 GROUP BY k) z
    ON z.x0 <= tile_col*20+20 AND z.x1 >= tile_col*20 AND z.y0 <= tile_row*20+20 AND z.y1 >= tile_row*20
    WHERE EXISTS (SELECT 1 FROM ze e WHERE e.k=z.k AND greatest(0e0,
        CASE WHEN e.x2=e.x1 THEN CASE WHEN e.x1 BETWEEN tile_col*20 AND tile_col*20+20 THEN 0e0 ELSE 2e0 END
             ELSE least((tile_col*20-e.x1)/(e.x2-e.x1),(tile_col*20+20-e.x1)/(e.x2-e.x1)) END,
        least((tile_row*20-e.y1)/(e.y2-e.y1),(tile_row*20+20-e.y1)/(e.y2-e.y1)))
      <= least(1e0, CASE WHEN e.x2=e.x1 THEN 1e0 ELSE greatest((tile_col*20-e.x1)/(e.x2-e.x1),(tile_col*20+20-e.x1)/(e.x2-e.x1)) END,
        greatest((tile_row*20-e.y1)/(e.y2-e.y1),(tile_row*20+20-e.y1)/(e.y2-e.y1))))
      OR (SELECT count(*) FROM ze e WHERE e.k=z.k AND tile_row*20+1e1 >= least(e.y1,e.y2) AND tile_row*20+1e1 < greatest(e.y1,e.y2)
          AND e.x1 + (tile_row*20+1e1-e.y1)*(e.x2-e.x1)/(e.y2-e.y1) <= tile_col*20+1e1) % 2 = 1"""))
def tiles_meeting_areas(spark, sf):
    tiles = fx.dem(spark, sf).select(
        F.expr("cast(row div 20 as int)").alias("tile_row"), F.expr("cast(col div 20 as int)").alias("tile_col")
    ).distinct()
    return vector.tiles_meeting(tiles, fx.zone_edges(spark, sf), 20.0, ["k"])


@query(sql("""SELECT row, col, arg_min(round(v,6), source) AS value, min(source) AS source FROM (
      SELECT row, col, t.r*3+t.c AS source, z + 1e-1*(t.r*3+t.c) AS v FROM gn JOIN
      (SELECT r.i AS r, c.j AS c FROM (SELECT DISTINCT row//40 AS i FROM g) r, (SELECT unnest(range(3)) AS j) c) t
      ON row >= t.r*40-10 AND row < t.r*40+50 AND col >= t.c*40-10 AND col < t.c*40+50 WHERE z <> -9999) GROUP BY 1,2"""))
def tile_mosaic_first_wins(spark, sf):
    """Blocks of 60 x 60 cells every 40 cells; block numbers give the source order."""
    near = lambda c: F.sequence(
        F.greatest(F.floor((F.col(c) - 50) / 40) + 1, F.lit(0)).cast("long"), F.floor((F.col(c) + 10) / 40).cast("long")
    )
    top = fx.grid(spark, sf).height - 1
    tiles = (
        gr.valid_cells(fx.dem_nodata(spark, sf))
        .select("row", "col", "value", F.explode(near("row")).alias("r"))
        .where(F.col("r") <= top // 40)
        .select("row", "col", "value", "r", F.explode(near("col")).alias("c"))
        .where("c <= 2")
        .withColumn("source", F.col("r") * 3 + F.col("c"))
        .withColumn("value", F.col("value") + 0.1 * F.col("source"))
    )
    return rounded(gr.mosaic(tiles).select("row", "col", "value", "source"))


@query(sql("SELECT id, round(8.3295e0*(col+5e-1)+1e3,6) AS x, round(5e5-8.3295e0*(row+5e-1),6) AS y FROM g"))
def cell_centre_coordinates(spark, sf):
    g = gr.Grid(100, fx.grid(spark, sf).height, 1000.0, 500000.0, 8.3295, -8.3295)
    x, y = gr.cell_xy(g)
    return rounded(fx.with_id(fx.dem(spark, sf)).select("id", x.alias("x"), y.alias("y")))


@query(sql("""SELECT f AS factor, row//f AS row, col//f AS col, round(avg(z),6) AS value FROM gn,
    (SELECT CAST(unnest([2,4,8,16]) AS INT) AS f) WHERE z <> -9999 GROUP BY ALL"""))
def overview_pyramid(spark, sf):
    cells = gr.valid_cells(fx.dem_nodata(spark, sf))
    return rounded(gr.overview_pyramid(cells, [2, 4, 8, 16]))


@query(sql("SELECT k, row, col FROM g JOIN zc ON zc.id=g.id"))
def polygon_rasterisation(spark, sf):
    return vector.rasterize_polygons(fx.zone_edges(spark, sf), fx.grid(spark, sf), ["k"])


@query(sql("SELECT row, col FROM rc"))
def line_rasterisation(spark, sf):
    return vector.rasterize_lines(fx.river_edges(spark, sf), fx.grid(spark, sf), []).distinct()


@query(sql("SELECT DISTINCT row, col, round(z,6) AS value FROM g JOIN zn ON zn.id=g.id WHERE r_name='ASIA'"))
def clip_raster_to_polygon(spark, sf):
    mask = fx.named_zone_cells(spark, sf).where("r_name = 'ASIA'")
    return rounded(gr.clip_to_mask(fx.dem(spark, sf), mask))


@query(sql("""SELECT DISTINCT g.row, g.col FROM (SELECT DISTINCT id FROM zn) zn JOIN g m ON m.id=zn.id, (SELECT unnest(range(-3,4)) AS dr) a, (SELECT unnest(range(-3,4)) AS dc) b JOIN g ON g.row=m.row+a.dr AND g.col=m.col+b.dc
    WHERE a.dr*a.dr+b.dc*b.dc <= 9"""))
def buffer_area_by_distance(spark, sf):
    return buffer_cells(fx.named_zone_cells(spark, sf), fx.grid(spark, sf), 3.0)


SLOPE = """SELECT g.id, g.row, g.col, sum(w.wx*coalesce(b.z, m.med)) AS sx, sum(w.wy*coalesce(b.z, m.med)) AS sy
    FROM g JOIN gn s ON s.id=g.id AND s.z<>-9999,
     (VALUES (-1,-1,-1e0,-1e0),(-1,0,0e0,-2e0),(-1,1,1e0,-1e0),(0,-1,-2e0,0e0),(0,1,2e0,0e0),(1,-1,-1e0,1e0),(1,0,0e0,2e0),(1,1,1e0,1e0)) w(dr,dc,wx,wy),
     h, (SELECT quantile_cont(z,0.5) AS med FROM gn WHERE z<>-9999) m
    LEFT JOIN gn b ON b.id = greatest(0,least(h.hi-1,g.row+w.dr))*100 + greatest(0,least(99,g.col+w.dc)) AND b.z<>-9999 GROUP BY ALL"""


@query(sql("SELECT row, col, round(degrees(atan(sqrt(pow(sx/8e0,2)+pow(sy/8e0,2)))),6) AS slope_deg FROM slopes", slopes=SLOPE))
def slope_horn(spark, sf):
    g = fx.grid(spark, sf)
    cells = gr.valid_cells(fx.dem_nodata(spark, sf))
    return rounded(focal.horn_slope(cells, g).select("row", "col", "slope_deg"))


@query(sql("""SELECT row, col, CAST(floor(greatest(0e0, least(255e0, ((sin(radians(45e0))*cos(slope) + cos(radians(45e0))*sin(slope)*cos(radians(315e0)-asp))+1e0)/2e0*255e0)) + 1e-9) AS INT) AS shade
    FROM (SELECT row, col, atan(sqrt(gx*gx+gy*gy)) AS slope, atan2(-gx, gy) AS asp FROM
     (SELECT s.row, s.col,
       CASE WHEN s.row=0 THEN coalesce(d.z,med)-s.z WHEN s.row=h.hi-1 THEN s.z-coalesce(u.z,med) ELSE (coalesce(d.z,med)-coalesce(u.z,med))/2e0 END AS gy,
       CASE WHEN s.col=0 THEN coalesce(r.z,med)-s.z WHEN s.col=99 THEN s.z-coalesce(l.z,med) ELSE (coalesce(r.z,med)-coalesce(l.z,med))/2e0 END AS gx
      FROM gnv s JOIN h ON TRUE JOIN gmed ON TRUE LEFT JOIN gnv u ON u.id=s.id-100 LEFT JOIN gnv d ON d.id=s.id+100
      LEFT JOIN gnv l ON l.id=s.id-1 AND s.col>0 LEFT JOIN gnv r ON r.id=s.id+1 AND s.col<99))""",
    gnv="SELECT * FROM gn WHERE z<>-9999", gmed="SELECT quantile_cont(z,0.5) AS med FROM gnv"))
def hillshade(spark, sf):
    cells = gr.valid_cells(fx.dem_nodata(spark, sf))
    return focal.hillshade(cells, fx.grid(spark, sf)).select("row", "col", "shade")


@query(sql("""SELECT g.row, g.col, round(quantile_cont(b.z,0.5),6) AS value FROM g,
     (SELECT unnest([-1,0,1]) AS dr) a, (SELECT unnest([-1,0,1]) AS dc) c JOIN gn b ON b.row=g.row+a.dr AND b.col=g.col+c.dc AND b.z<>-9999
     GROUP BY g.row, g.col"""))
def median_filter(spark, sf):
    cells = gr.valid_cells(fx.dem_nodata(spark, sf))
    return rounded(focal.median3(cells, fx.dem(spark, sf)))


@query(sql("""SELECT DISTINCT g.row, g.col FROM rc JOIN g o ON o.id=rc.id, (SELECT unnest(range(-2,3)) AS dr) a, (SELECT unnest(range(-2,3)) AS dc) c
    JOIN g ON g.row=o.row+a.dr AND g.col=o.col+c.dc"""))
def square_dilation(spark, sf):
    return focal.dilate(fx.river_cells(spark, sf), 2, fx.grid(spark, sf))


MASK_AB = {"ma": "SELECT id FROM zn WHERE r_name='ASIA'", "mb": "SELECT id FROM obs",
    "fl": "SELECT coalesce(a.id,b.id) AS id, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b FROM (SELECT DISTINCT id FROM ma) a FULL JOIN mb b ON a.id=b.id"}


def _mask_ab(spark, sf):
    a = fx.named_zone_cells(spark, sf).where("r_name = 'ASIA'").select("row", "col")
    return a, fx.observed(spark, sf)


@query(sql("""SELECT CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col, CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'a' ELSE 'b' END AS side FROM fl""", **MASK_AB))
def mask_algebra(spark, sf):
    """Intersection, both differences and (as their union) the union of two masks."""
    a, b = _mask_ab(spark, sf)
    both = masks.intersection(a, b).withColumn("side", F.lit("both"))
    only_a = masks.difference(a, b).withColumn("side", F.lit("a"))
    only_b = masks.difference(b, a).withColumn("side", F.lit("b"))
    return both.unionByName(only_a).unionByName(only_b)


@query(sql("""SELECT round(i/u,6) AS iou, round(2e0*i/(u+i),6) AS dice, i AS intersection_cells, u AS union_cells, a AS only_a_cells, b AS only_b_cells, i=u AS identical
    FROM (SELECT count(*) FILTER (in_a AND in_b) AS i, count(*) AS u, count(*) FILTER (in_a AND NOT in_b) AS a, count(*) FILTER (in_b AND NOT in_a) AS b FROM fl)""", **MASK_AB))
def mask_overlap(spark, sf):
    return rounded(masks.overlap_counts(*_mask_ab(spark, sf)))


@query(sql("""SELECT CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col, CASE WHEN in_a AND in_b THEN 1 WHEN in_a THEN 2 ELSE 3 END AS agreement FROM fl""", **MASK_AB))
def agreement_raster(spark, sf):
    return masks.agreement_classes(*_mask_ab(spark, sf))


@query(sql("""SELECT z AS zone_cells, c AS captured_cells, z-c AS remaining_cells, round(c*69.381334e0/1e6,6) AS captured_km2,
    round((z-c)*69.381334e0/1e6,6) AS remaining_km2, round(c/z,6) AS captured_fraction, round((z-c)/z,6) AS remaining_fraction
    FROM (SELECT count(*) FILTER (in_a) AS z, count(*) FILTER (in_a AND in_b) AS c FROM fl)""", **MASK_AB))
def subset_capture(spark, sf):
    return rounded(masks.subset_capture(*_mask_ab(spark, sf), fx.CELL_AREA))


@query(sql(f"""SELECT count(*) AS compared_cells, count(*) FILTER (abs(d)>1e-6) AS changed_cells, count(*) FILTER (d>1e-3) AS raised_cells,
    count(*) FILTER (d<-1e-3) AS lowered_cells, round(avg(d),6) AS mean_delta, round(avg(abs(d)),6) AS mean_abs_delta, round(min(d),6) AS min_delta,
    round(max(d),6) AS max_delta, round({Q}(d,0.01),6) AS p01_delta, round({Q}(d,0.99),6) AS p99_delta
    FROM (SELECT b.z-a.z AS d FROM g a JOIN galt b ON a.id=b.id)"""))
def raster_difference(spark, sf):
    return rounded(masks.difference_stats(fx.dem(spark, sf), fx.dem_alt(spark, sf)))
