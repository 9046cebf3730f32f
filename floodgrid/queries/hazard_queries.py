"""Flood index, water depth, hazard classes, zonal statistics and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgrid.functions import hazard as hz
from floodgrid.functions.rounding import rounded
from floodgrid.operators import hydro, masks, polygon_overlay, validate, vector, zonal
from floodgrid.plans import flood_index as fi
from floodgrid.queries import fixtures as fx
from floodgrid.queries.flow_queries import SEED, _seeds
from floodgrid.queries.registry import query
from floodgrid.queries.sqlparts import sql

KM2 = "69.381334e0/1e6"
NAMES = [s[0] for s in fi.SCENARIOS]
THRESHOLDS = [-0.6, -0.53, -0.4, -0.2, 0.0, 0.2]


@query(sql("SELECT id, target, round(h,6) AS h, round(hadj,6) AS h_adj, ariver FROM raw"))
def height_above_channel(spark, sf):
    return rounded(fx.index(spark, sf).select("id", "target", "h", "h_adj", "ariver"))


@query(sql("SELECT id, round(hr,6) AS hr, round(gfi,6) AS gfi FROM raw"))
def flood_index_raw(spark, sf):
    return rounded(fx.index(spark, sf).select("id", "hr", "gfi"))


@query(sql("SELECT id, round(norm,6) AS norm FROM gfi WHERE norm IS NOT NULL"))
def flood_index_normalised(spark, sf):
    return rounded(fx.index(spark, sf).where("norm is not null").select("id", "norm"))


@query(sql("""SELECT count(*) AS analysis_cells, count(target) AS resolved_cells, count(*) FILTER (target IS NULL) AS unresolved_cells,
    count(*) FILTER (h<0) AS negative_h_cells, count(*) FILTER (h=0) AS zero_h_cells, count(gfi) AS finite_index_cells FROM gfi"""))
def routing_counts(spark, sf):
    return fi.routing_counts(fx.index(spark, sf))


@query(sql("""SELECT variable, count(x) AS cells, round(min(x),6) AS min_value, round(avg(x),6) AS mean_value, round(max(x),6) AS max_value,
    round(quantile_cont(x,0.01),6) AS p01, round(quantile_cont(x,0.05),6) AS p05, round(quantile_cont(x,0.25),6) AS p25, round(quantile_cont(x,0.5),6) AS median,
    round(quantile_cont(x,0.75),6) AS p75, round(quantile_cont(x,0.95),6) AS p95, round(quantile_cont(x,0.99),6) AS p99 FROM
    (SELECT 'h_adjusted' AS variable, hadj AS x FROM gfi WHERE h>=0 UNION ALL SELECT 'ariver_km2', (ariver+1e0)*69.381334e0/1e6 FROM gfi WHERE ariver IS NOT NULL
     UNION ALL SELECT 'hr', hr FROM gfi WHERE hr IS NOT NULL UNION ALL SELECT 'gfi_raw', gfi FROM gfi WHERE gfi.gfi IS NOT NULL UNION ALL SELECT 'gfi_norm', norm FROM gfi WHERE norm IS NOT NULL) GROUP BY variable"""))
def index_variable_statistics(spark, sf):
    return rounded(fi.variable_stats(fx.index(spark, sf), fx.CELL_AREA))


@query(sql("""SELECT count(wd) AS cells, count(*) FILTER (wd<0) AS negative_cells, count(*) FILTER (abs(wd)<=1e-12) AS zero_cells, count(*) FILTER (wd>0) AS positive_cells,
    round(min(wd),6) AS min_wd, round(avg(wd),6) AS mean_wd, round(max(wd),6) AS max_wd, round(avg(greatest(wd,0e0)),6) AS mean_clamped_wd FROM gfi WHERE norm > -0.53e0"""))
def water_depth_audit(spark, sf):
    idx = fx.index(spark, sf)
    return rounded(fi.depth_counts(idx, idx.where("norm > -0.53")))


SENS = {
    "tv": "SELECT unnest([-0.6e0,-0.53e0,-0.4e0,-0.2e0,0e0,0.2e0]) AS threshold",
    "tc": "SELECT threshold, id, row, col, wd FROM gfi JOIN tv ON norm > threshold",
    # Runs of neighbouring columns per row are the nodes of the component search.
    "runs": """SELECT threshold, id, row, col, wd, min(id) OVER (PARTITION BY threshold, row, col-rn) AS run FROM
        (SELECT *, row_number() OVER (PARTITION BY threshold, row ORDER BY col) AS rn FROM tc)""",
    "tadj": """SELECT DISTINCT a.threshold, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.threshold=b.threshold AND b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1""",
    "treach": "SELECT DISTINCT threshold, run AS src, run AS node FROM runs UNION SELECT r.threshold, r.src, j.b FROM treach r JOIN tadj j ON j.threshold=r.threshold AND j.a=r.node",
    "tlab": "SELECT threshold, node AS run, min(src) AS label FROM treach GROUP BY 1,2",
    "tcell": "SELECT r.*, l.label, count(*) OVER (PARTITION BY r.threshold, l.label) AS n FROM runs r JOIN tlab l ON l.threshold=r.threshold AND l.run=r.run",
    "tsum": """SELECT threshold, count(*) FILTER (n>=8) AS cells, count(*) FILTER (n>=8 AND wd>0) AS pos, count(*) FILTER (n>=8 AND wd<0) AS neg,
        count(*) FILTER (n>=8 AND abs(wd)<=1e-12) AS zer, count(DISTINCT label) AS cb, count(DISTINCT label) FILTER (n>=8) AS ca, coalesce(max(n) FILTER (n>=8),0) AS big FROM tcell GROUP BY 1""",
    "tot": "SELECT count(norm) AS valid, count(*) FILTER (wd>0 AND norm IS NOT NULL) AS phys FROM gfi",
}


@query(sql("SELECT row, col FROM tcell WHERE threshold=-0.53e0 AND n>=8", **SENS))
def prone_mask(spark, sf):
    kept, _ = fi.prone_mask(fx.index(spark, sf), fx.grid(spark, sf))
    return kept.select("row", "col")


@query(sql(f"""SELECT threshold, cells, round(cells*{KM2},6) AS area_km2, round(1e2*cells/valid,6) AS percent_valid, pos AS positive_wd_cells, neg AS negative_wd_cells, zer AS zero_wd_cells,
    cb AS components_before, ca AS components_after, round(big*{KM2},6) AS largest_km2, round(CASE WHEN cells>0 THEN pos/cells ELSE 0e0 END,6) AS physical_precision,
    round(pos/phys,6) AS physical_recall, round(pos/(cells+phys-pos),6) AS physical_jaccard FROM tsum JOIN tot ON TRUE""", **SENS))
def threshold_sensitivity(spark, sf):
    return rounded(fi.threshold_sensitivity(fx.index(spark, sf), fx.grid(spark, sf), THRESHOLDS, fx.CELL_AREA))


@query(sql("""SELECT round(min(gfi),6) AS raw_min, round(max(gfi),6) AS raw_max, count(*) FILTER ((wd>0)<>(gfi>0)) AS disagreeing_cells,
    round(2e0*((0e0-min(gfi))/(max(gfi)-min(gfi))-5e-1),6) AS norm_at_zero FROM gfi WHERE norm IS NOT NULL"""))
def zero_crossing(spark, sf):
    return rounded(fi.zero_crossing(fx.index(spark, sf)))


@query(sql("""SELECT l_orderkey, l_linenumber, round(sum(m),6) AS membership FROM (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_discount-5e-2<=0 THEN 0e0 ELSE 1e0/(1e0+pow((l_discount-5e-2)*5e1/1.125e0, -1.75e0)) END AS m FROM lineitem) GROUP BY 1,2"""))
def fuzzy_large_membership(spark, sf):
    m = hz.fuzzy_large((F.col("l_discount") - 0.05) * 50.0, hz.FUZZY_MIDPOINT, 1.75)
    t = fx.table(spark, sf, "lineitem").withColumn("m", m)
    return rounded(t.groupBy("l_orderkey", "l_linenumber").agg(F.sum("m").alias("membership")))


@query(sql("SELECT scenario, row, col, cls FROM hc"))
def hazard_classes(spark, sf):
    return fx.hazard(spark, sf).select("scenario", "row", "col", "cls")


@query(sql(f"""SELECT scenario, mask, spread, count(*) AS cells, round(count(*)*{KM2},6) AS area_km2, count(*) FILTER (wd<0) AS negative_wd_cells, count(*) FILTER (wd>0) AS positive_wd_cells,
    round(count(*) FILTER (cls=1)*{KM2},6) AS low_km2, round(count(*) FILTER (cls=2)*{KM2},6) AS medium_km2, round(count(*) FILTER (cls=3)*{KM2},6) AS high_km2,
    round(1e2*count(*) FILTER (cls=1)/count(*),6) AS low_percent, round(1e2*count(*) FILTER (cls=2)/count(*),6) AS medium_percent, round(1e2*count(*) FILTER (cls=3)/count(*),6) AS high_percent FROM hc GROUP BY 1,2,3"""))
def hazard_scenario_summary(spark, sf):
    return rounded(fi.scenario_summary(fx.hazard(spark, sf), fx.CELL_AREA))


@fx.shared
def _seeded_channels(spark, sf):
    """Channels below slope-area seeds."""
    seeds = hydro.propagate_downstream(fx.flow(spark, sf), _seeds(spark, sf), fx.grid(spark, sf))
    return seeds.join(fx.acc(spark, sf), ["row", "col"])


def _channel_sets(spark, sf):
    """Channels below slope-area seeds, and channels by catchment size."""
    return {"slope_area": _seeded_channels(spark, sf), "area_threshold": fx.channels(spark, sf)}


METHOD = {
    **SEED,
    "ch2": "SELECT 'slope_area' AS method, cur AS id FROM spaths UNION ALL SELECT 'area_threshold', id FROM chan",
    "meth": "SELECT * FROM (VALUES ('slope_area'),('area_threshold')) v(method)",
    "ml": "SELECT m.method, l.id, l.nxt FROM meth m JOIN links l ON TRUE LEFT JOIN ch2 c ON c.method=m.method AND c.id=l.id WHERE c.id IS NULL",
    "mp": "SELECT m.method, d.id AS src, d.id AS cur FROM meth m JOIN d8 d ON TRUE UNION ALL SELECT p.method, p.src, l.nxt FROM mp p JOIN ml l ON l.method=p.method AND l.id=p.cur",
    "mt": "SELECT p.method, p.src AS id, p.cur AS target FROM mp p JOIN ch2 c ON c.method=p.method AND c.id=p.cur",
    "mh": """SELECT m.method, f.id, f.row, f.col, t.target, CASE WHEN f.z-c.z=0 THEN 1e-5 ELSE f.z-c.z END AS h, pow((c.acc+1e0)*69.381334e0/1e6, 0.354429752e0) AS hr
        FROM meth m JOIN flow f ON TRUE LEFT JOIN mt t ON t.method=m.method AND t.id=f.id LEFT JOIN flow c ON c.id=t.target""",
    "mg": "SELECT *, CASE WHEN h>0 THEN ln(hr/h) END AS gfi, hr-h AS wd FROM mh",
    "mn": "SELECT *, 2e0*((gfi-min(gfi) OVER (PARTITION BY method))/(max(gfi) OVER (PARTITION BY method)-min(gfi) OVER (PARTITION BY method))-5e-1) AS norm FROM mg",
    "tc": "SELECT method AS threshold, id, row, col, wd FROM mn WHERE norm > -0.53e0",
    **{k: v for k, v in SENS.items() if k in ("runs", "tadj", "treach", "tlab", "tcell")},
    "mpr": "SELECT threshold AS method, count(*) AS n, count(*) FILTER (wd<0) AS neg, count(*) FILTER (wd>0) AS pos FROM tcell WHERE n>=8 GROUP BY 1",
}


@query(sql(f"""SELECT a.method, a.analysis_cells, a.resolved_cells, a.unresolved_cells, a.channel_cells, round(a.lo,6) AS min_index, round(a.hi,6) AS max_index, a.negative_h_cells, a.finite_index_cells, p.n AS prone_cells, round(p.n*{KM2},6) AS prone_km2, p.neg AS prone_negative_wd_cells, p.pos AS prone_positive_wd_cells, a.physical_cells,
    (SELECT count(DISTINCT label) FROM tcell WHERE threshold=a.method) AS components_before, (SELECT count(DISTINCT label) FROM tcell WHERE threshold=a.method AND n>=8) AS components_after
    FROM (SELECT method, count(*) AS analysis_cells, count(target) AS resolved_cells, count(*)-count(target) AS unresolved_cells, count(*) FILTER (target=id) AS channel_cells, min(gfi) AS lo, max(gfi) AS hi, count(*) FILTER (h<0) AS negative_h_cells, count(gfi) AS finite_index_cells, count(*) FILTER (wd>0) AS physical_cells FROM mn GROUP BY 1) a JOIN mpr p ON p.method=a.method""", **METHOD))
def channel_method_comparison(spark, sf):
    """Two channel definitions through the whole chain."""
    g = fx.grid(spark, sf)
    return rounded(fi.method_comparison(fx.flow(spark, sf), fx.acc(spark, sf), _channel_sets(spark, sf), g, fx.CELL_AREA))


METHOD2 = {
    **METHOD,
    "mk": "SELECT mn.*, t.threshold IS NOT NULL AS prone FROM mn LEFT JOIN (SELECT DISTINCT threshold, id FROM tcell WHERE n>=8) t ON t.threshold=mn.method AND t.id=mn.id",
}


def _method_statistics(spark, sf):
    return fi.method_statistics(fx.flow(spark, sf), fx.acc(spark, sf), _channel_sets(spark, sf), fx.grid(spark, sf), fx.CELL_AREA)


@query(sql(f"""SELECT method, round(1e2*count(target)/count(*),6) AS resolved_percent, count(*) FILTER (target IS NOT NULL AND h=1e-5) AS zero_h_cells,
    round(2e0*((0e0-min(gfi))/(max(gfi)-min(gfi))-5e-1),6) AS zero_index_threshold,
    round(1e2*count(*) FILTER (prone AND wd<0)/count(*) FILTER (prone),6) AS prone_negative_percent, round(1e2*count(*) FILTER (prone AND wd>0)/count(*) FILTER (prone),6) AS prone_positive_percent,
    round(count(*) FILTER (gfi>0)*{KM2},6) AS physical_km2 FROM mk GROUP BY method""", **METHOD2))
def channel_method_shares(spark, sf):
    return rounded(_method_statistics(spark, sf)[0])


@query(sql("""SELECT method, variable, count(x) AS cells, round(min(x),6) AS min_value, round(avg(x),6) AS mean_value, round(max(x),6) AS max_value,
    round(quantile_cont(x,0.01),6) AS p01, round(quantile_cont(x,0.05),6) AS p05, round(quantile_cont(x,0.25),6) AS p25, round(quantile_cont(x,0.5),6) AS median,
    round(quantile_cont(x,0.75),6) AS p75, round(quantile_cont(x,0.95),6) AS p95, round(quantile_cont(x,0.99),6) AS p99 FROM
    (SELECT method, 'height' AS variable, h AS x FROM mk WHERE h>=0 UNION ALL SELECT method, 'river_depth', hr FROM mk WHERE hr IS NOT NULL UNION ALL SELECT method, 'index', gfi FROM mk WHERE gfi IS NOT NULL
     UNION ALL SELECT method, 'depth_prone', wd FROM mk WHERE prone UNION ALL SELECT method, 'depth_positive', wd FROM mk WHERE prone AND wd>0) GROUP BY method, variable""", **METHOD2))
def channel_method_statistics(spark, sf):
    return rounded(_method_statistics(spark, sf)[1])


# --- administrative statistics ---


@query("""SELECT p_partkey, upper(trim(regexp_replace('  '||p_name||'   x ','\\s+',' ','g'))) AS plain, upper(trim(regexp_replace(regexp_replace(p_brand||'_/'||p_name||'.','[._,/\\\\-]+',' ','g'),'\\s+',' ','g'))) AS name,
    CASE WHEN strpos(' '||upper(p_name)||' ',' RING ')>0 THEN 'RING' WHEN strpos(' '||upper(p_name)||' ',' SMALL ')>0 THEN 'SMALL' END AS canonical FROM part""")
def text_normalisation(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        zonal.normalise_text(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("plain"),
        zonal.normalise_name(F.concat("p_brand", F.lit("_/"), "p_name", F.lit("."))).alias("name"),
        zonal.canonical_name(F.col("p_name"), ["RING", "SMALL"]).alias("canonical"),
    )


ATTRS = {"attrs": """SELECT 0 AS pos, 'c_name' AS field, c_name AS value, c_custkey FROM customer UNION ALL SELECT 1, 'c_mktsegment', c_mktsegment, c_custkey FROM customer
    UNION ALL SELECT 2, 'c_nationkey', CAST(c_nationkey AS VARCHAR), c_custkey FROM customer"""}
FIELDS = ["c_name", "c_mktsegment", "c_nationkey"]


def _attrs(spark, sf):
    return zonal.unpivot_text(fx.table(spark, sf, "customer"), FIELDS, ["c_custkey"])


@query(sql("""SELECT field, count(DISTINCT CASE WHEN upper(trim(value)) IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN upper(trim(value)) END) AS expected_values,
    CASE WHEN field='c_mktsegment' THEN 2 END AS preferred FROM attrs GROUP BY field""", **ATTRS))
def field_detection(spark, sf):
    return zonal.detect_field(_attrs(spark, sf), ["SEGMENT", "C_MKTSEGMENT"], ["building", "machinery", "household"])


@query(sql("""SELECT field, count(DISTINCT CASE WHEN NOT regexp_matches(value,'^[+-]?[0-9]*\\.?[0-9]+$') THEN upper(trim(value)) END) AS distinct_texts FROM attrs GROUP BY field""", **ATTRS))
def text_field_scores(spark, sf):
    return zonal.text_field_scores(_attrs(spark, sf))


@query(sql("""SELECT field, position, value FROM (SELECT field, value, CAST(row_number() OVER (PARTITION BY field ORDER BY min(c_custkey), value) AS INT) AS position FROM attrs GROUP BY field, value) WHERE position<=8""", **ATTRS))
def column_value_profile(spark, sf):
    return zonal.value_profile(_attrs(spark, sf), "c_custkey")


# Squares around suppliers against triangles around customers, both spread by their balances.
SQ = """SELECT s_suppkey AS a, s_acctbal/2.3e1 AS cx, (s_suppkey % 37)*1e1 AS cy, 9e0+s_nationkey/5.3e0 AS r FROM supplier"""
TRI = """SELECT c_custkey AS b, c_acctbal/2.3e1+3e-1 AS cx, (c_custkey % 41)*9e0+1e-1 AS cy, 6e0+c_nationkey/4.1e0 AS r FROM customer"""


def _squares_and_triangles(spark, sf):
    s = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("a"), (F.col("s_acctbal") / 23.0).alias("cx"), ((F.col("s_suppkey") % 37) * 10.0).alias("cy"),
        (9.0 + F.col("s_nationkey") / 5.3).alias("r"),
    )
    c = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("b"), (F.col("c_acctbal") / 23.0 + 0.3).alias("cx"), ((F.col("c_custkey") % 41) * 9.0 + 0.1).alias("cy"),
        (6.0 + F.col("c_nationkey") / 4.1).alias("r"),
    )

    def shape(df, key, corners):
        ring = F.array(*[F.array(F.col("cx") + dx * F.col("r"), F.col("cy") + dy * F.col("r")) for dx, dy in corners])
        return df.select(key, F.array(F.array(ring)).alias("coords"))

    sq = shape(s, "a", [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)])
    tri = shape(c, "b", [(0, -1), (1, 0), (-1, 0), (0, -1)])
    return sq, tri


# The triangle has width 2r(1-d) at distance d*r below its upper side; cutting it by a square is an
# integral of the clipped width over the common height, piecewise quadratic, here by its break points.
@query(
    """WITH sq AS (""" + SQ + """), tri AS (""" + TRI + """),
    p AS (SELECT sq.a, tri.b, sq.cx-sq.r AS qx0, sq.cx+sq.r AS qx1, greatest(sq.cy-sq.r, tri.cy-tri.r) AS lo, least(sq.cy+sq.r, tri.cy) AS hi, tri.cx AS tx, tri.cy AS ty, tri.r AS tr
      FROM sq JOIN tri ON sq.cx-sq.r <= tri.cx+tri.r AND sq.cx+sq.r >= tri.cx-tri.r AND sq.cy-sq.r <= tri.cy AND sq.cy+sq.r >= tri.cy-tri.r),
    br AS (SELECT *, unnest([lo, hi, ty-tr+(tx-qx0), ty-tr+(qx0-tx), ty-tr+(qx1-tx), ty-tr+(tx-qx1)]) AS y FROM p WHERE hi > lo),
    cl AS (SELECT *, least(hi, greatest(lo, y)) AS yy FROM br),
    st AS (SELECT *, lead(yy) OVER (PARTITION BY a,b ORDER BY yy) AS y2 FROM cl),
    ar AS (SELECT a, b, (y2-yy)/2e0*(greatest(0e0, least(qx1, tx+(yy-ty+tr))-greatest(qx0, tx-(yy-ty+tr))) + greatest(0e0, least(qx1, tx+(y2-ty+tr))-greatest(qx0, tx-(y2-ty+tr)))) AS s FROM st WHERE y2 IS NOT NULL)
    SELECT a, b, round(sum(s),4) AS area FROM ar GROUP BY a, b HAVING sum(s) > 1e-3""")
def polygon_intersection_areas(spark, sf):
    sq, tri = _squares_and_triangles(spark, sf)
    sq_edges, tri_edges = vector.edges(sq, ["a"]), vector.edges(tri, ["b"])
    sq_boxes = polygon_overlay.with_shapes(vector.bounding_box(sq, ["a"]), sq_edges, "a")
    tri_boxes = polygon_overlay.with_shapes(vector.bounding_box(tri, ["b"]), tri_edges, "b")
    pairs = polygon_overlay.bbox_pairs(sq_boxes, tri_boxes, "a", "b", 40.0)
    out = polygon_overlay.intersection_areas(pairs, sq_edges, tri_edges, "a", "b", 40.0)
    return rounded(out.where("area > 1e-3"), 4)


# The ground below a line through the orders' totals is one outline of as many edges as there are orders;
# squares of the customers lie along it.
PLOT = """SELECT c_custkey AS b, (c_custkey*7919) % (n-7) + 3e-1 AS x0, abs(c_acctbal)/2.5e2 AS y0, 1.3e0+c_nationkey/5e0 AS w FROM customer, (SELECT max(o_orderkey) AS n FROM orders)"""


def _outline_edges(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1e4).alias("h"))
    n = o.agg(F.max("i")).scalar()
    i = F.col("i").cast("double")
    up = o.join(o.select((F.col("i") - 1).alias("i"), F.col("h").alias("h2")), "i").select("i", i.alias("x1"), F.col("h").alias("y1"), (i + 1).alias("x2"), F.col("h2").alias("y2"))
    ends = o.where((F.col("i") == 0) | (F.col("i") == n)).agg(F.max_by("h", "i").alias("hn"), F.min_by("h", "i").alias("h0"), n.alias("n"))
    x, zero = F.col("n").cast("double"), F.lit(0.0)
    corners = [(0, x, F.col("hn"), x, zero), (1, x, zero, zero, zero), (2, zero, zero, zero, F.col("h0"))]
    rest = F.array(*[F.struct((F.col("n") + k).alias("i"), a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for k, a, b, c, d in corners])
    both = up.unionByName(ends.select(F.inline(rest)))
    return both.select(F.lit(0).alias("a"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("i").alias("seq"), "x1", "y1", "x2", "y2")


def _plots(spark, sf):
    n = fx.table(spark, sf, "orders").agg(F.max("o_orderkey").alias("n"))
    c = fx.table(spark, sf, "customer").join(F.broadcast(n)).select(
        F.col("c_custkey").alias("b"), ((F.col("c_custkey") * 7919) % (F.col("n") - 7) + 0.3).alias("x0"),
        (F.abs("c_acctbal") / 250.0).alias("y0"), (1.3 + F.col("c_nationkey") / 5.0).alias("w"),
    )
    ring = F.array(*[F.array(F.col("x0") + dx * F.col("w"), F.col("y0") + dy * F.col("w")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return c.select("b", F.array(F.array(ring)).alias("coords"))


# Over one unit of the line the height above a level is a linear function cut off at zero.
@query(
    "WITH pl AS (" + PLOT + """),
    ln AS (SELECT o.o_orderkey AS i, o.o_totalprice/1e4 AS h, p.o_totalprice/1e4 AS h2 FROM orders o JOIN orders p ON p.o_orderkey=o.o_orderkey+1),
    st AS (SELECT b, y0, y0+w AS y1, x0, x0+w AS x1, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x0+w) AS BIGINT)+1)) AS i FROM pl),
    se AS (SELECT b, y0, y1, greatest(x0,i)-i AS u, least(x1,i+1)-i AS v, h, h2 FROM st JOIN ln USING (i)),
    en AS (SELECT b, y0, y1, v-u AS w, h+(h2-h)*u AS p, h+(h2-h)*v AS q FROM se WHERE v>u),
    lv AS (SELECT b, w, p-y0 AS p, q-y0 AS q, 1 AS sign FROM en UNION ALL SELECT b, w, p-y1, q-y1, -1 FROM en)
    SELECT b, round(sum(sign*w*CASE WHEN p>=0 AND q>=0 THEN (p+q)/2 WHEN p<=0 AND q<=0 THEN 0 ELSE greatest(p,q)*greatest(p,q)/(2*abs(q-p)) END),4) AS area
    FROM lv GROUP BY b HAVING sum(sign*w*CASE WHEN p>=0 AND q>=0 THEN (p+q)/2 WHEN p<=0 AND q<=0 THEN 0 ELSE greatest(p,q)*greatest(p,q)/(2*abs(q-p)) END) > 1e-3""")
def outline_plot_areas(spark, sf):
    line, plots = _outline_edges(spark, sf), _plots(spark, sf)
    whole = line.groupBy("a").agg(F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))
    pairs = polygon_overlay.meeting_boxes(whole, vector.bounding_box(plots, ["b"]), ["a"], ["b"])
    out = polygon_overlay.intersection_areas(pairs, line, vector.edges(plots, ["b"]), "a", "b", 8.0)
    return rounded(out.where("area > 1e-3").select("b", "area"), 4)


@query(sql("SELECT DISTINCT rk, row, col FROM zn JOIN g ON g.id=zn.id"))
def dissolve_to_parent(spark, sf):
    return zonal.dissolve(fx.named_zone_cells(spark, sf), ["rk"])


@query(sql("""SELECT rk, k, level, units, round(area,6) AS area, round(1e2*area/(SELECT count(*) FROM basin),6) AS percent_of_basin FROM
    (SELECT rk, k, CAST(0 AS BIGINT) AS level, 1::BIGINT AS units, sum(n) AS area FROM zb GROUP BY 1,2 UNION ALL SELECT rk, NULL, 1, count(*), sum(n) FROM zb GROUP BY rk
     UNION ALL SELECT NULL, NULL, 3, count(*), sum(n) FROM zb)""",
    zb="SELECT rk, k, count(*)*1e0 AS n FROM zn JOIN basin ON basin.id=zn.id GROUP BY 1,2"))
def coverage_audit(spark, sf):
    basin = fx.basin(spark, sf)
    pieces = fx.named_zone_cells(spark, sf).join(basin, ["row", "col"], "left_semi").groupBy("rk", "k").agg(
        F.count("*").cast("double").alias("area")
    )
    total = basin.agg(F.count("*").cast("double")).scalar()
    return rounded(zonal.coverage_by_level(pieces, "rk", "k", "area", total))


def _shares(prefix=""):
    out = [f"round(zc_*{KM2},6) AS zone_km2", f"round(zc_*69.381334e0/1e4,6) AS zone_ha", f"round(hc_*{KM2},6) AS hazard_km2", "round(hc_*69.381334e0/1e4,6) AS hazard_ha",
           "round(CASE WHEN zc_>0 THEN 1e2*hc_/zc_ ELSE 0e0 END,6) AS hazard_pct_zone"]
    for n, k in (("low", 1), ("medium", 2), ("high", 3)):
        out += [f"c{k} AS {n}_cells", f"round(c{k}*{KM2},6) AS {n}_km2", f"round(CASE WHEN hc_>0 THEN 1e2*c{k}/hc_ ELSE 0e0 END,6) AS {n}_pct_hazard", f"round(CASE WHEN zc_>0 THEN 1e2*c{k}/zc_ ELSE 0e0 END,6) AS {n}_pct_zone"]
    return "zc_ AS zone_cells, hc_ AS hazard_cells, " + ", ".join(out)


ZST = {"zst": """SELECT s.scenario, zn.k, zn.n_name, zn.rk, count(*) AS zc_, count(cls) AS hc_, count(*) FILTER (cls=1) AS c1, count(*) FILTER (cls=2) AS c2, count(*) FILTER (cls=3) AS c3
    FROM zn JOIN scen s ON TRUE LEFT JOIN hc ON hc.id=zn.id AND hc.scenario=s.scenario GROUP BY 1,2,3,4"""}


def _primary(spark, sf, scenario="P175"):
    return fx.hazard(spark, sf).where(F.col("scenario") == scenario)


@query(sql(f"SELECT k, n_name, {_shares()} FROM zst WHERE scenario='P175'", **ZST))
def zone_class_statistics(spark, sf):
    z = fx.named_zone_cells(spark, sf).select("k", "n_name", "row", "col")
    return rounded(zonal.zone_class_stats(z, _primary(spark, sf), ["k", "n_name"], fx.CELL_AREA))


@query(sql(f"""SELECT n_nationkey AS k, n_name, n.zc_ IS NOT NULL AS intersects, {_shares()} FROM (SELECT n_nationkey, n_name, z.zc_ AS zz, coalesce(z.zc_,0) AS zc_, coalesce(hc_,0) AS hc_, coalesce(c1,0) AS c1, coalesce(c2,0) AS c2, coalesce(c3,0) AS c3
    FROM nation LEFT JOIN (SELECT * FROM fst) z ON z.k=n_nationkey WHERE n_name IN ('NATION_2','NATION_7','NATION_13')) n""".replace("n.zc_ IS NOT NULL", "n.zz IS NOT NULL"),
    fst="""SELECT zn.k, count(*) AS zc_, count(cls) AS hc_, count(*) FILTER (cls=1) AS c1, count(*) FILTER (cls=2) AS c2, count(*) FILTER (cls=3) AS c3
    FROM zn JOIN basin b ON b.id=zn.id LEFT JOIN hc ON hc.id=zn.id AND hc.scenario='P175' GROUP BY 1"""))
def focus_units(spark, sf):
    """Units are clipped to the basin; one of the named units lies outside it."""
    z = fx.zone_cells(spark, sf).join(fx.basin(spark, sf), ["row", "col"], "left_semi")
    stats = zonal.zone_class_stats(z, _primary(spark, sf), ["k"], fx.CELL_AREA)
    zones = fx.zones(spark, sf).select("k", "n_name")
    return rounded(zonal.focus_units(zones, stats, "k", ["nation_2", "nation_7", "nation_13"], "n_name"))


@query(sql(f"SELECT scenario, k, {_shares()} FROM zst", **ZST))
def scenario_zone_sensitivity(spark, sf):
    sc = F.explode(F.array(*[F.lit(s) for s in NAMES])).alias("scenario")
    z = fx.zone_cells(spark, sf).select("k", "row", "col", sc)
    h = fx.hazard(spark, sf).select("scenario", "row", "col", "cls")
    return rounded(zonal.class_shares(z.join(h, ["scenario", "row", "col"], "left").groupBy("scenario", "k"), fx.CELL_AREA))


@query(sql(f"SELECT k, round(c3*{KM2},6) AS high_km2 FROM zst WHERE scenario='P175' ORDER BY c3 DESC, k LIMIT 10", **ZST))
def top_zones_by_high_hazard(spark, sf):
    stats = zonal.zone_class_stats(fx.zone_cells(spark, sf), _primary(spark, sf), ["k"], fx.CELL_AREA)
    return rounded(zonal.top_zones(stats, "high_km2", "k").select("k", "high_km2"))


CONS = {
    "base": "SELECT c_custkey, c_nationkey, n_regionkey, round(c_acctbal*1e2) AS c_acctbal, 1e0 AS n FROM customer JOIN nation ON n_nationkey=c_nationkey",
    "lv": """SELECT 'customer' AS level, n, c_acctbal AS bal FROM base UNION ALL SELECT 'nation', count(*)*1e0, sum(c_acctbal) FROM base GROUP BY c_nationkey
        UNION ALL SELECT 'region', count(*)*1e0, sum(c_acctbal) FROM base GROUP BY n_regionkey""",
    "sums": "SELECT level, sum(n) AS n, sum(bal) AS bal FROM lv GROUP BY level",
    "totals": "SELECT sum(n) AS n, sum(c_acctbal) AS bal FROM base",
    "cons": """SELECT level, metric, v, t, v-t AS d, n0 FROM (SELECT level, 'n' AS metric, s.n AS v, t.n AS t, t.n AS n0 FROM sums s JOIN totals t ON TRUE
        UNION ALL SELECT level, 'bal', s.bal, t.bal, t.n FROM sums s JOIN totals t ON TRUE)""",
}


def _conservation(spark, sf):
    n = fx.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = fx.table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("n", F.lit(1.0)).withColumn("bal", F.round(F.col("c_acctbal") * 100))
    pick = lambda df, name: df.select(F.lit(name).alias("level"), "n", "bal")
    sums = [F.sum("n").alias("n"), F.sum("bal").alias("bal")]
    levels = (
        pick(c, "customer")
        .unionByName(pick(c.groupBy("c_nationkey").agg(*sums), "nation"))
        .unionByName(pick(c.groupBy("n_regionkey").agg(*sums), "region"))
    )
    return zonal.conservation(levels, c.agg(*sums), ["n", "bal"], "n")


@query(sql("""SELECT level, metric, round(v,4) AS level_sum, round(t,4) AS basin_total, round(d,4) AS difference, round(1e2*abs(d)/n0,4) AS pct_of_basin, round(1e2*abs(d)/t,4) AS pct_of_metric,
    1e2*abs(d)/n0 <= 0.1e0 AS within_tolerance, (max(d) OVER (PARTITION BY metric))-(min(d) OVER (PARTITION BY metric)) < 1e-9 AS levels_consistent FROM cons""", **CONS))
def hierarchy_conservation(spark, sf):
    return rounded(_conservation(spark, sf), 4)


@query(sql("""SELECT CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'REVIEW' END AS verdict, count(*) AS checks FROM
    (SELECT 1e2*abs(d)/n0 <= 0.1e0 AND (max(d) OVER (PARTITION BY metric))-(min(d) OVER (PARTITION BY metric)) < 1e-9 AS ok FROM cons)""", **CONS))
def conservation_verdict(spark, sf):
    return zonal.conservation_verdict(_conservation(spark, sf))


# --- validation ---

SCORES = """round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) END,6) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) END,6) AS recall, round(CASE WHEN 2*tp+fp+fn>0 THEN 2e0*tp/(2*tp+fp+fn) END,6) AS f1,
    round(CASE WHEN tp+fp+fn>0 THEN tp/(tp+fp+fn) END,6) AS iou, round(CASE WHEN tn+fp>0 THEN tn/(tn+fp) END,6) AS specificity,
    round((CASE WHEN tp+fn>0 THEN tp/(tp+fn) END + CASE WHEN tn+fp>0 THEN tn/(tn+fp) END)/2e0,6) AS balanced_accuracy,
    tp AS tp_cells, fp AS fp_cells, fn AS fn_cells, tn AS tn_cells, tp+fp+fn+tn AS zone_cells, round((tp+fp)*""" + KM2 + """,6) AS predicted_km2, round((tp+fn)*""" + KM2 + """,6) AS observed_km2"""
CONF = {
    "cf": """SELECT s.scenario, b.id, hc.id IS NOT NULL AS p, o.id IS NOT NULL AS o FROM basin b JOIN scen s ON TRUE LEFT JOIN hc ON hc.id=b.id AND hc.scenario=s.scenario LEFT JOIN obs o ON o.id=b.id""",
    "ct": """SELECT scenario, count(*) FILTER (p AND o) AS tp, count(*) FILTER (p AND NOT o) AS fp, count(*) FILTER (NOT p AND o) AS fn, count(*) FILTER (NOT p AND NOT o) AS tn FROM cf GROUP BY 1""",
    "cz": """SELECT scenario, k, count(*) FILTER (p AND o) AS tp, count(*) FILTER (p AND NOT o) AS fp, count(*) FILTER (NOT p AND o) AS fn, count(*) FILTER (NOT p AND NOT o) AS tn
        FROM cf JOIN zc ON zc.id=cf.id GROUP BY 1,2""",
}


def _scenario_flags(spark, sf):
    return validate.scenario_flags(fx.basin(spark, sf), fx.hazard(spark, sf), fx.observed(spark, sf), NAMES)


@query(sql(f"SELECT scenario, {SCORES} FROM ct", **CONF))
def confusion_metrics(spark, sf):
    return rounded(validate.confusion_metrics(_scenario_flags(spark, sf), ["scenario"], fx.CELL_AREA))


def _zone_scores(spark, sf, keep):
    zones = fx.zones(spark, sf).select("k")
    return validate.by_zone(_scenario_flags(spark, sf), fx.zone_cells(spark, sf), zones, "k", NAMES, fx.CELL_AREA, keep)


@query(sql(f"""SELECT scenario, k, {SCORES} FROM (SELECT s.scenario, n_nationkey AS k, coalesce(tp,0) AS tp, coalesce(fp,0) AS fp, coalesce(fn,0) AS fn, coalesce(tn,0) AS tn
    FROM nation JOIN scen s ON TRUE LEFT JOIN cz ON cz.k=n_nationkey AND cz.scenario=s.scenario)""", **CONF))
def confusion_by_zone_all(spark, sf):
    return rounded(_zone_scores(spark, sf, True))


@query(sql(f"SELECT scenario, k, {SCORES} FROM cz", **CONF))
def confusion_by_zone_nonempty(spark, sf):
    return rounded(_zone_scores(spark, sf, False))


@query(sql("SELECT CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col, CASE WHEN p AND o THEN 2 WHEN p THEN 3 WHEN o THEN 4 ELSE 1 END AS confusion FROM cf WHERE scenario='P175'", **CONF))
def confusion_raster(spark, sf):
    c = validate.confusion_cells(fx.basin(spark, sf), _primary(spark, sf), fx.observed(spark, sf))
    return c.select("row", "col", validate.confusion_class().alias("confusion"))


@query(sql(f"""SELECT s.scenario, c.class, count(hc.id) AS observed_cells, round(count(hc.id)*{KM2},6) AS observed_km2, round(1e2*count(hc.id)/(SELECT count(*) FROM obs),6) AS pct_of_observed
    FROM scen s JOIN (VALUES (1,'LOW'),(2,'MEDIUM'),(3,'HIGH')) c(cls,class) ON TRUE LEFT JOIN (SELECT hc.* FROM hc JOIN obs ON obs.id=hc.id) hc ON hc.scenario=s.scenario AND hc.cls=c.cls GROUP BY 1,2"""))
def observed_composition(spark, sf):
    return rounded(validate.observed_composition(fx.observed(spark, sf), fx.hazard(spark, sf), NAMES, fx.CELL_AREA))


@query(sql("""SELECT (SELECT count(*) FROM ((SELECT id FROM hc WHERE scenario='P175') EXCEPT (SELECT id FROM hc WHERE scenario='P250')))=0 AS physical_equal,
    (SELECT count(*) FROM ((SELECT id FROM hc WHERE scenario='M175') EXCEPT (SELECT id FROM hc WHERE scenario='P175')))=0
      AND (SELECT count(*) FROM ((SELECT id FROM hc WHERE scenario='P175') EXCEPT (SELECT id FROM hc WHERE scenario='M175')))=0 AS manual_equals_physical"""))
def scenario_domain_equivalence(spark, sf):
    h = fx.hazard(spark, sf)
    of = lambda s: h.where(F.col("scenario") == s)
    same = lambda a, b: masks.overlap_counts(of(a), of(b)).select("identical").scalar()
    one = fx.table(spark, sf, "orders").agg(F.count("*").alias("n"))
    return one.select(same("P175", "P250").alias("physical_equal"), same("M175", "P175").alias("manual_equals_physical"))


TOL = {
    "rad": "SELECT CAST(unnest([0,1,2,3,5]) AS INT) AS r",
    "hx": "SELECT scenario, hc.id, row, col FROM hc",
    "ox": "SELECT g.id, g.row, g.col FROM g JOIN obs ON obs.id=g.id",
    "cap": """SELECT s.scenario, rad.r, count(*) AS n FROM ox o JOIN scen s ON TRUE JOIN rad ON TRUE WHERE EXISTS
        (SELECT 1 FROM hx WHERE hx.scenario=s.scenario AND hx.row BETWEEN o.row-rad.r AND o.row+rad.r AND hx.col BETWEEN o.col-rad.r AND o.col+rad.r) GROUP BY 1,2""",
    "con": """SELECT scenario, r, count(*) AS n FROM hx JOIN rad ON TRUE WHERE EXISTS (SELECT 1 FROM ox o WHERE o.row BETWEEN hx.row-rad.r AND hx.row+rad.r AND o.col BETWEEN hx.col-rad.r AND hx.col+rad.r) GROUP BY 1,2""",
    "pt": """SELECT s.scenario, rad.r, coalesce(cap.n,0) AS a, coalesce(con.n,0) AS b, coalesce(cap.n,0)/(SELECT count(*) FROM ox) AS rec, coalesce(con.n,0)/(SELECT count(*) FROM hx WHERE hx.scenario=s.scenario) AS prec
        FROM scen s JOIN rad ON TRUE LEFT JOIN cap ON cap.scenario=s.scenario AND cap.r=rad.r LEFT JOIN con ON con.scenario=s.scenario AND con.r=rad.r""",
}


@query(sql(f"""SELECT scenario, r AS radius, round(a*{KM2},6) AS captured_km2, round(b*{KM2},6) AS confirmed_km2, round(rec,6) AS recall, round(prec,6) AS precision,
    round(CASE WHEN prec+rec>0 THEN 2e0*prec*rec/(prec+rec) END,6) AS f1 FROM pt""", **TOL))
def positional_tolerance(spark, sf):
    return rounded(
        validate.positional_tolerance(fx.hazard(spark, sf), fx.observed(spark, sf), [0, 1, 2, 3, 5], NAMES, fx.CELL_AREA)
    )


@query("""SELECT bool_or(strpos(upper(c_mktsegment),'BUILD')>0) AS has_c_mktsegment, bool_or(strpos(upper(c_name),'#000000003')>0) AS has_c_name, bool_or(strpos(upper(c_mktsegment),'ACEH')>0) AS conflict_c_mktsegment,
    bool_or(strpos(upper(c_mktsegment),'BUILD')>0) AND bool_or(strpos(upper(c_name),'#000000003')>0) AND NOT bool_or(strpos(upper(c_mktsegment),'ACEH')>0) AS accepted FROM customer""")
def provenance_gate(spark, sf):
    return validate.provenance_gate(
        fx.table(spark, sf, "customer"), {"c_mktsegment": "build", "c_name": "#000000003"}, {"c_mktsegment": "aceh"}
    )


@query(sql("SELECT field, trim(value) AS value, min(c_custkey) AS first_seen FROM attrs WHERE trim(value)<>'' GROUP BY 1,2", **ATTRS))
def distinct_values_in_order(spark, sf):
    return validate.distinct_in_order(_attrs(spark, sf), "field", "value", "c_custkey")


@query("""SELECT key, min(o_orderkey) AS first_seen FROM (SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'P' THEN ['status','priority','hold'] WHEN 'F' THEN ['status','priority','closed'] ELSE ['status'] END) AS key FROM orders) GROUP BY key""")
def attribute_key_union(spark, sf):
    def attrs(*names):
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col("o_orderpriority")] * len(names)))

    m = (
        F.when(F.col("o_orderstatus") == "P", attrs("status", "priority", "hold"))
        .when(F.col("o_orderstatus") == "F", attrs("status", "priority", "closed"))
        .otherwise(attrs("status"))
    )
    return validate.attribute_keys(fx.table(spark, sf, "orders").withColumn("attrs", m), "attrs", "o_orderkey")


@query(sql("""SELECT round(sum(n)*69.381334e0/1e4,6) AS sum_ha, round(count(*)*69.381334e0/1e4,6) AS union_ha, round(sum(n)*69.381334e0/1e4-count(*)*69.381334e0/1e4,6) AS overlap_ha
    FROM (SELECT id, count(*) AS n FROM zc GROUP BY id)"""))
def clip_area_versus_union(spark, sf):
    return rounded(validate.clip_versus_union(fx.zone_cells(spark, sf), "k", fx.CELL_AREA))


@query(sql("""SELECT i AS intersection_cells, u AS union_cells, a AS only_a_cells, b AS only_b_cells, round(i/u,6) AS iou, round(2e0*i/(u+i),6) AS dice, i=u AS identical FROM
    (SELECT count(*) FILTER (h.id IS NOT NULL AND o.id IS NOT NULL) AS i, count(*) AS u, count(*) FILTER (o.id IS NULL) AS a, count(*) FILTER (h.id IS NULL) AS b FROM (SELECT id FROM hc WHERE scenario='M175') h FULL JOIN obs o ON o.id=h.id)"""))
def cross_source_overlap(spark, sf):
    return rounded(masks.overlap_counts(_primary(spark, sf, "M175"), fx.observed(spark, sf)))


@query(sql("""SELECT scenario, k, fn AS fn_cells, observed_rank, missed_rank FROM (SELECT scenario, k, fn, CAST(row_number() OVER (PARTITION BY scenario ORDER BY tp+fn DESC, k) AS INT) AS observed_rank,
    CAST(row_number() OVER (PARTITION BY scenario ORDER BY fn DESC, k) AS INT) AS missed_rank FROM cz WHERE tp+fn>0) WHERE observed_rank<=10 OR missed_rank<=10""", **CONF))
def validation_ranking(spark, sf):
    out = validate.ranked_zones(_zone_scores(spark, sf, False), "k")
    return out.select("scenario", "k", "fn_cells", "observed_rank", "missed_rank")
