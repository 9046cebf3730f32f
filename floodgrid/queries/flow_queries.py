"""Distances, components, flow routing, streams, outlets and watersheds."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgrid.functions.rounding import rounded
from floodgrid.operators import components, distance, hydro, vector
from floodgrid.operators.tilegraph import label_components
from floodgrid.plans import streams as sweep
from floodgrid.queries import fixtures as fx
from floodgrid.queries.registry import query
from floodgrid.queries.sqlparts import sql

Q = "quantile_cont"
DIST_RIVER = """SELECT g.id, g.row, g.col, sqrt(min((r.row-g.row)*(r.row-g.row)+(r.col-g.col)*(r.col-g.col))) AS dist FROM g, rc r GROUP BY ALL"""
BASIN_OUT = """SELECT id, row, col FROM g WHERE id NOT IN (SELECT id FROM basin)"""
# Only outside cells with an inside neighbour can be nearest to an inside cell.
BASIN_RIM = """SELECT DISTINCT o.id, o.row, o.col FROM basinout o JOIN g n ON abs(n.row-o.row)<=1 AND abs(n.col-o.col)<=1 AND n.row BETWEEN o.row-1 AND o.row+1 JOIN basin b ON b.id=n.id"""
DIST_IN = """SELECT g.id, g.row, g.col, sqrt(min((r.row-g.row)*(r.row-g.row)+(r.col-g.col)*(r.col-g.col))) AS dist FROM g JOIN basin ON basin.id=g.id, basinrim r GROUP BY g.id, g.row, g.col"""
D = {"dr_": DIST_RIVER, "basinout": BASIN_OUT, "basinrim": BASIN_RIM, "di_": DIST_IN}


@query(sql("SELECT row, col, round(dist,6) AS dist FROM dr_", **D))
def distance_to_rivers(spark, sf):
    return rounded(distance.distance_to(fx.river_cells(spark, sf), fx.grid(spark, sf)))


@query(sql("SELECT row, col, round(dist,6) AS dist FROM di_", **D))
def distance_inside_basin(spark, sf):
    return rounded(distance.distance_inside(fx.basin(spark, sf), fx.grid(spark, sf)))


LABELS = {
    "m": "SELECT g.id, g.row, g.col FROM g JOIN obs ON obs.id=g.id",
    "adj": """SELECT a.id AS a, b.id AS b FROM m a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dr,dc)
        JOIN m b ON b.row=a.row+s.dr AND b.col=a.col+s.dc""",
    "reach": "SELECT id AS src, id AS node FROM m UNION SELECT r.src, adj.b FROM reach r JOIN adj ON adj.a=r.node",
    "lab": "SELECT node AS id, min(src) AS label FROM reach GROUP BY node",
    "labs": "SELECT label, count(*) AS cells FROM lab GROUP BY label",
}


@query(sql("SELECT CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col, label FROM lab", **LABELS))
def connected_components(spark, sf):
    return label_components(fx.observed(spark, sf), fx.grid(spark, sf))


@query(sql("""SELECT count(*) AS components_before, count(*) FILTER (cells>=4) AS components_after,
    CAST(sum(cells) FILTER (cells>=4) AS BIGINT) AS kept_cells FROM labs""", **LABELS))
def small_component_removal(spark, sf):
    kept, counts = components.remove_small(fx.observed(spark, sf), fx.grid(spark, sf), 4)
    return counts.withColumn("kept_cells", kept.agg(F.count("*")).scalar())


@query(sql("""SELECT row_number() OVER (ORDER BY n DESC, label) AS rank, label, n AS cells, round(n*1e0/1e6,9) AS area_km2, round_even(c,0)+5e-1 AS centroid_x, round_even(r,0)+5e-1 AS centroid_y
    FROM (SELECT label, count(*) AS n, avg(CAST(lab.id//100 AS DOUBLE)) AS r, avg(CAST(lab.id%100 AS DOUBLE)) AS c FROM lab GROUP BY label) WHERE n>=3 ORDER BY n DESC, label LIMIT 50""", **LABELS))
def component_summary(spark, sf):
    g = fx.grid(spark, sf)
    out = components.component_summary(label_components(fx.observed(spark, sf), g), g, 3e-6, 50)
    return out.withColumn("area_km2", F.round("area_km2", 9))


@query(sql("""SELECT label, count(*) AS cells, round(max(z),6) AS max_value, round(avg(CAST(col AS DOUBLE))+5e-1,6) AS x, round(avg(CAST(row AS DOUBLE))+5e-1,6) AS y, count(*)*1e0 AS area_m2
    FROM lab JOIN g ON g.id=lab.id GROUP BY label HAVING count(*)>=3""", **LABELS))
def component_hotspots(spark, sf):
    g = fx.grid(spark, sf)
    return rounded(components.component_hotspots(label_components(fx.observed(spark, sf), g), fx.dem(spark, sf), g))


@query(sql("SELECT row, col, pointer FROM d8"))
def flow_pointer(spark, sf):
    return fx.flow(spark, sf).select("row", "col", "pointer")


@query(sql("""SELECT row, col, CASE pointer WHEN 1 THEN 128 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 4 WHEN 16 THEN 8 WHEN 32 THEN 16 WHEN 64 THEN 32 WHEN 128 THEN 64 ELSE 0 END AS esri FROM d8"""))
def flow_pointer_recoded(spark, sf):
    return fx.flow(spark, sf).select("row", "col", hydro.recode_pointer(F.col("pointer")).alias("esri"))


@query(sql("""SELECT pointer, count(*) AS cells, pointer IN (0,1,2,4,8,16,32,64,128) AS expected FROM
    (SELECT CASE WHEN o_orderpriority='5-LOW' AND o_orderstatus='P' THEN pointer+1 ELSE pointer END AS pointer FROM d8 JOIN orders ON o_orderkey=id) GROUP BY 1,3"""))
def flow_pointer_counts(spark, sf):
    """Codes damaged for some cells, so that unexpected ones occur."""
    o = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")).alias("damaged"),
    )
    p = fx.flow(spark, sf).join(o, "id").select(
        F.when(F.col("damaged"), F.col("pointer") + 1).otherwise(F.col("pointer")).alias("pointer")
    )
    return hydro.pointer_counts(p)


@query(sql("SELECT row, col, flow.acc, round(flow.acc*69.381334e0/1e6,6) AS area_km2 FROM flow"))
def flow_accumulation(spark, sf):
    return rounded(fx.acc(spark, sf).withColumn("area_km2", F.col("acc") * fx.CELL_AREA / 1e6))


@query("""SELECT o_custkey, round(o_totalprice/1e5,9) AS area_km2, CAST(ceil(o_totalprice/1e5*1e6/69.381334e0) AS BIGINT) AS min_cells FROM orders""")
def stream_threshold_cells(spark, sf):
    km2 = F.col("o_totalprice") / 1e5
    return rounded(
        fx.table(spark, sf, "orders").select(
            "o_custkey", km2.alias("area_km2"), hydro.min_cells_column(km2, fx.CELL_AREA).alias("min_cells")
        ),
        9,
    )


@query(sql("SELECT row, col, flow.acc FROM flow JOIN basin ON basin.id=flow.id WHERE flow.acc >= 100"))
def stream_extraction(spark, sf):
    return hydro.streams(fx.acc(spark, sf), fx.CHANNEL_CELLS, fx.basin(spark, sf))


SEED = {
    "slopes": """SELECT g.id, g.row, g.col, sum(w.wx*b.z) AS sx, sum(w.wy*b.z) AS sy
    FROM g, (VALUES (-1,-1,-1e0,-1e0),(-1,0,0e0,-2e0),(-1,1,1e0,-1e0),(0,-1,-2e0,0e0),(0,1,2e0,0e0),(1,-1,-1e0,1e0),(1,0,0e0,2e0),(1,1,1e0,1e0)) w(dr,dc,wx,wy),
     h JOIN g b ON b.id = greatest(0,least(h.hi-1,g.row+w.dr))*100 + greatest(0,least(99,g.col+w.dc)) GROUP BY ALL""",
    "sa": """SELECT s.id, s.row, s.col, f.acc*pow(atan(sqrt(pow(sx/8e0,2)+pow(sy/8e0,2)))+1e-4,1.7e0) AS slope_area FROM slopes s JOIN flow f ON f.id=s.id""",
    "seed": "SELECT id FROM sa WHERE slope_area > 2e0",
    "spaths": "SELECT id AS cur FROM seed UNION SELECT l.nxt FROM spaths p JOIN links l ON l.id=p.cur",
}


def _seeds(spark, sf):
    from floodgrid.operators import focal

    g = fx.grid(spark, sf)
    return hydro.slope_area_seeds(focal.horn_slope(fx.dem(spark, sf), g), fx.acc(spark, sf), g, 2.0)


@query(sql("SELECT row, col, round(slope_area,6) AS slope_area FROM sa WHERE slope_area > 2e0", **SEED))
def slope_area_channel_seeds(spark, sf):
    return rounded(_seeds(spark, sf).select("row", "col", "slope_area"))


@query(sql("SELECT CAST(cur//100 AS INT) AS row, CAST(cur%100 AS INT) AS col FROM spaths", **SEED))
def downstream_propagation(spark, sf):
    return hydro.propagate_downstream(fx.flow(spark, sf), _seeds(spark, sf), fx.grid(spark, sf))


@query(sql("SELECT d8.id, t.target FROM d8 LEFT JOIN tgt t ON t.id=d8.id"))
def first_downstream_channel(spark, sf):
    return hydro.channel_targets(fx.flow(spark, sf), fx.channels(spark, sf))


POUR = {
    "pour": "SELECT id FROM rc",
    "plinks": "SELECT l.id, l.nxt FROM links l LEFT JOIN pour c ON c.id=l.id WHERE c.id IS NULL",
    "ppaths": "SELECT id AS src, id AS cur FROM d8 UNION ALL SELECT p.src, l.nxt FROM ppaths p JOIN plinks l ON l.id=p.cur",
}


@query(sql("SELECT CAST(src//100 AS INT) AS row, CAST(src%100 AS INT) AS col, cur AS outlet FROM ppaths JOIN pour ON pour.id=cur", **POUR))
def watershed_by_pour_points(spark, sf):
    """The river cells are the pour points."""
    return hydro.watersheds(fx.flow(spark, sf), fx.river_cells(spark, sf), fx.grid(spark, sf))


EXITS = {
    "bd": "SELECT d8.* FROM d8 JOIN basin ON basin.id=d8.id",
    "ex": """SELECT b.id, b.row, b.col, CASE WHEN b.pointer=0 THEN 'pointer_zero' ELSE 'boundary_exit' END AS kind, a.acc
        FROM bd b JOIN acc a ON a.id=b.id LEFT JOIN basin n ON n.id=b.nxt WHERE b.pointer=0 OR n.id IS NULL""",
    "exr": "SELECT row_number() OVER (ORDER BY ex.acc DESC, row, col) AS outlet_id, id, row, col, kind, ex.acc FROM ex",
    "blinks": "SELECT b.id, b.nxt FROM bd b JOIN basin n ON n.id=b.nxt",
    "bpaths": "SELECT id AS src, id AS cur FROM bd UNION ALL SELECT p.src, l.nxt FROM bpaths p JOIN blinks l ON l.id=p.cur",
    "parts": "SELECT e.outlet_id, count(*) AS cells FROM bpaths p JOIN exr e ON e.id=p.cur GROUP BY 1",
    "exd": "SELECT e.*, p.cells*69.381334e0/1e6 AS area_km2, d.dist AS river_dist FROM exr e JOIN parts p ON p.outlet_id=e.outlet_id JOIN dr_ d ON d.id=e.id",
}


def _exits(spark, sf):
    ex = hydro.flow_exits(fx.flow(spark, sf), fx.grid(spark, sf), fx.basin(spark, sf))
    return ex.join(fx.acc(spark, sf), ["row", "col"])


@query(sql("SELECT row, col, kind FROM ex", **EXITS))
def flow_exits(spark, sf):
    return _exits(spark, sf).select("row", "col", "kind")


@query(sql("SELECT outlet_id, row, col, kind, exr.acc FROM exr", **EXITS))
def exit_ranking(spark, sf):
    return hydro.rank_exits(_exits(spark, sf)).select("outlet_id", "row", "col", "kind", "acc")


def _basin_labels(spark, sf):
    """Every basin cell with the ranked exit it drains to (flow cut at the basin border)."""
    g, basin = fx.grid(spark, sf), fx.basin(spark, sf)
    ranked = hydro.rank_exits(_exits(spark, sf))
    inside = fx.flow(spark, sf).drop("id", "next").join(basin, ["row", "col"], "left_semi")
    sheds = hydro.watersheds(hydro.with_next(inside, g, within=basin), ranked, g, keep_unassigned=True)
    ids = fx.with_id(ranked).select(F.col("id").alias("outlet"), "outlet_id")
    return sheds.join(ids, "outlet", "left"), ranked


@query(sql("""SELECT * FROM (SELECT count(*) AS basin_cells, count(*) FILTER (q.row % 2 = 1) AS assigned_cells, count(*) FILTER (q.row % 2 = 0) AS unassigned_cells FROM
    (SELECT p.src, e.row FROM bpaths p JOIN exr e ON e.id=p.cur) q)""", **EXITS))
def partition_completeness(spark, sf):
    """Only exits in odd rows take cells; cells of the other exits stay as unassigned."""
    return _completeness(spark, sf, hydro.rank_exits(_exits(spark, sf)).where("row % 2 = 1"))


@query(sql("""SELECT b.n AS basin_cells, a.n AS assigned_cells, b.n - a.n AS unassigned_cells FROM (SELECT count(*) AS n FROM bd) b,
    (SELECT count(*) AS n FROM bpaths p JOIN exr e ON e.id=p.cur) a""", **EXITS))
def partition_completeness_all_exits(spark, sf):
    """The report on the whole partition: every exit takes its cells."""
    return _completeness(spark, sf, hydro.rank_exits(_exits(spark, sf)))


def _completeness(spark, sf, ranked):
    g, basin = fx.grid(spark, sf), fx.basin(spark, sf)
    inside = fx.flow(spark, sf).drop("id", "next").join(basin, ["row", "col"], "left_semi")
    sheds = hydro.watersheds(hydro.with_next(inside, g, within=basin), ranked, g, keep_unassigned=True)
    return sheds.agg(F.count("*").alias("basin_cells"), F.count("outlet").alias("assigned_cells"), F.count_if(F.col("outlet").isNull()).alias("unassigned_cells"))


@query(sql("SELECT outlet_id, cells, round(cells*69.381334e0/1e6,6) AS area_km2 FROM parts", **EXITS))
def partition_areas(spark, sf):
    labels, _ = _basin_labels(spark, sf)
    return rounded(hydro.partition_areas(labels, fx.CELL_AREA, "outlet_id"))


CANDS = {"cands": """SELECT f.id, f.row, f.col, f.acc, d.dist AS river_dist, i.dist AS boundary_dist FROM flow f JOIN dr_ d ON d.id=f.id JOIN di_ i ON i.id=f.id WHERE f.acc>=20"""}


def _candidates(spark, sf, boundary_tol, river_tol):
    g = fx.grid(spark, sf)
    return hydro.outlet_candidates(
        fx.acc(spark, sf),
        fx.basin(spark, sf),
        fx.river_cells(spark, sf),
        g,
        20,
        boundary_tol,
        river_tol,
    )


@query(sql("""SELECT row, col, cands.acc, round(boundary_dist,6) AS boundary_dist, round(river_dist,6) AS river_dist FROM cands
    WHERE boundary_dist<=5 AND river_dist<=10 ORDER BY cands.acc DESC, row, col LIMIT 20""", **CANDS, **D))
def outlet_candidates(spark, sf):
    return rounded(hydro.top_by_accumulation(_candidates(spark, sf, 5.0, 10.0), 20))


@query(sql("""SELECT p.id AS point_id, arg_max(b.row, b.acc*1000000-b.id) AS row, arg_max(b.col, b.acc*1000000-b.id) AS col, max(b.acc) AS acc
    FROM flow p JOIN rc ON rc.id=p.id JOIN flow b ON b.row BETWEEN p.row-3 AND p.row+3 AND b.col BETWEEN p.col-3 AND p.col+3 GROUP BY p.id"""))
def snap_to_local_maximum(spark, sf):
    starts = fx.with_id(fx.river_cells(spark, sf)).withColumnRenamed("id", "point_id")
    return hydro.snap_to_maximum(starts, fx.acc(spark, sf), fx.grid(spark, sf), 3.0)


@query(sql("""SELECT b.t AS boundary_tol, r.t AS river_tol, count(c.id) AS candidate_cells, arg_max(c.row, c.acc*1000000-c.id) AS row,
    arg_max(c.col, c.acc*1000000-c.id) AS col, max(c.acc) AS acc FROM (SELECT unnest([0.5e0,1e0,2e0,5e0,10e0]) AS t) b, (SELECT unnest([0e0,1e0,2e0,4e0,8e0,16e0]) AS t) r
    LEFT JOIN cands c ON c.boundary_dist<=b.t AND c.river_dist<=r.t GROUP BY 1,2""", **CANDS, **D))
def outlet_window_audit(spark, sf):
    c = _candidates(spark, sf, 10.0, 16.0)
    return hydro.outlet_window_audit(c, [0.5, 1, 2, 5, 10], [0, 1, 2, 4, 8, 16])


@query(sql("SELECT row, col, flow.acc FROM flow JOIN basin ON basin.id=flow.id WHERE flow.acc>=20 ORDER BY flow.acc DESC, row, col LIMIT 1"))
def main_outlet_in_basin(spark, sf):
    """The largest stream cell anywhere in the basin, beside the windowed audit."""
    return hydro.top_by_accumulation(hydro.streams(fx.acc(spark, sf), 20, fx.basin(spark, sf)), 1)


CLUSTER = {
    "near": "SELECT a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b ON sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 2e0",
    "creach": "SELECT point_id AS src, point_id AS node FROM pts UNION SELECT r.src, near.b FROM creach r JOIN near ON near.a=r.node",
}


@query(sql("SELECT node AS point_id, min(src) AS label FROM creach GROUP BY node", **CLUSTER))
def radius_clusters(spark, sf):
    return hydro.exit_clusters(fx.points(spark, sf), 2.0)


ZONESUM = {
    **EXITS, **D,
    "enear": "SELECT a.outlet_id AS a, b.outlet_id AS b FROM exd a JOIN exd b ON sqrt((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col)) <= 3e0",
    "ereach": "SELECT outlet_id AS src, outlet_id AS node FROM exd UNION SELECT r.src, enear.b FROM ereach r JOIN enear ON enear.a=r.node",
    "elab": "SELECT node AS outlet_id, min(src) AS label FROM ereach GROUP BY node",
    "esum": """SELECT label, count(*) AS exit_cells, sum(area_km2) AS area_km2, sum(greatest(area_km2,1e-12)*(col+5e-1))/sum(greatest(area_km2,1e-12)) AS centroid_x,
        sum(greatest(area_km2,1e-12)*(row+5e-1))/sum(greatest(area_km2,1e-12)) AS centroid_y, min(river_dist) AS min_river_dist, max(exd.acc) AS max_acc
        FROM exd JOIN elab ON elab.outlet_id=exd.outlet_id GROUP BY label""",
}


def _zoned_exits(spark, sf):
    g = fx.grid(spark, sf)
    labels, ranked = _basin_labels(spark, sf)
    area = hydro.partition_areas(labels, fx.CELL_AREA, "outlet_id").select("outlet_id", "area_km2")
    near = distance.distance_to(fx.river_cells(spark, sf), g).withColumnRenamed("dist", "river_dist")
    ex = hydro.exit_points(ranked, g).join(area, "outlet_id").join(near, ["row", "col"])
    ex = ex.withColumn("point_id", F.col("outlet_id"))
    return ex.join(hydro.exit_clusters(ex, 3.0), "point_id"), labels


@query(sql("""SELECT row_number() OVER (ORDER BY round(area_km2,9) DESC, label) AS rank, label, exit_cells, round(area_km2,6) AS area_km2, round(centroid_x,6) AS centroid_x,
    round(centroid_y,6) AS centroid_y, round(min_river_dist,6) AS min_river_dist, max_acc, area_km2>=1e-2 AS major FROM esum""", **ZONESUM))
def exit_zone_summary(spark, sf):
    ex, _ = _zoned_exits(spark, sf)
    return rounded(hydro.zone_summary(ex.withColumn("area_km2", F.round("area_km2", 12)), "label", 0.01))


@query(sql("""SELECT count(*) AS zone_cells, round(count(*)*69.381334e0/1e6,6) AS zone_km2, (SELECT arg_max(exd.outlet_id, exd.acc*1000000-exd.outlet_id) FROM exd JOIN elab ON elab.outlet_id=exd.outlet_id WHERE label=zz.zlabel) AS dominant_exit,
    round(min(f.z),6) AS min_z, round(quantile_cont(f.z,0.5),6) AS median_z, round(max(f.z),6) AS max_z, round(avg(b.z-f.z),6) AS mean_fill, round(max(b.z-f.z),6) AS max_fill,
    count(*) FILTER (b.z-f.z > 1e-2) AS fill_cells, count(*) FILTER (f.acc>=20) AS stream_cells, count(*) FILTER (f.acc>=20 AND d.dist<=5) AS stream_cells_near
    FROM (SELECT arg_min(label, r) AS zlabel FROM (SELECT label, row_number() OVER (ORDER BY round(area_km2,9) DESC, label) AS r FROM esum) WHERE r=2) zz
    JOIN elab ON elab.label=zz.zlabel JOIN exr e ON e.outlet_id=elab.outlet_id JOIN bpaths p ON p.cur=e.id JOIN flow f ON f.id=p.src JOIN galt b ON b.id=f.id JOIN dr_ d ON d.id=f.id GROUP BY zz.zlabel""", **ZONESUM))
def secondary_zone_profile(spark, sf):
    ex, labels = _zoned_exits(spark, sf)
    return rounded(
        sweep.zone_profile(
            ex.withColumn("area_km2", F.round("area_km2", 12)), labels, fx.dem(spark, sf), fx.dem_alt(spark, sf), fx.acc(spark, sf), fx.river_cells(spark, sf), fx.grid(spark, sf), 2, 20, 5.0, 0.01, fx.CELL_AREA
        )
    )


@query(sql(f"""SELECT count(*) AS valid_cells, round(count(*)*69.381334e0/1e6,6) AS area_km2, round(avg(d),6) AS mean_fill, round(max(d),6) AS max_fill,
    count(*) FILTER (d>1e-3) AS cells_gt_0_001, count(*) FILTER (d>1e-2) AS cells_gt_0_01, count(*) FILTER (d>2e-2) AS cells_gt_0_02,
    round({Q}(d,0.5),6) AS p50, round({Q}(d,0.9),6) AS p90, round({Q}(d,0.95),6) AS p95, round({Q}(d,0.99),6) AS p99, round({Q}(d,0.999),6) AS p99_9
    FROM (SELECT b.z-a.z AS d FROM g a JOIN galt b ON a.id=b.id JOIN basin ON basin.id=a.id)"""))
def fill_depth_audit(spark, sf):
    a, b = fx.dem(spark, sf), fx.dem_alt(spark, sf).withColumnRenamed("value", "filled")
    d = a.join(b, ["row", "col"]).join(fx.basin(spark, sf), ["row", "col"], "left_semi")
    return rounded(hydro.fill_depth_audit(d.withColumn("depth", F.col("filled") - F.col("value")), [0.001, 0.01, 0.02], fx.CELL_AREA))


SWEEP = {
    "th": "SELECT unnest([50,100,200,400]) AS t",
    "net": "SELECT t, f.id, f.row, f.col, f.pointer, f.nxt FROM flow f JOIN basin ON basin.id=f.id JOIN th ON f.acc>=t",
    "elinks": """SELECT a.t, a.id AS a, b.id AS b, sqrt(CASE WHEN a.row<>b.row AND a.col<>b.col THEN 2e0 ELSE 1e0 END) AS len FROM net a JOIN net b ON a.t=b.t AND a.nxt=b.id""",
    "inflow": "SELECT n.t, n.id, count(e.a) AS k FROM net n LEFT JOIN elinks e ON e.t=n.t AND e.b=n.id GROUP BY 1,2",
    "nadj": """SELECT a.t, a.id AS a, b.id AS b FROM net a JOIN net b ON a.t=b.t AND b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1""",
    "nreach": "SELECT t, id AS src, id AS node FROM net UNION SELECT r.t, r.src, j.b FROM nreach r JOIN nadj j ON j.t=r.t AND j.a=r.node WHERE j.b > -1",
    "nlab": "SELECT t, node, min(src) AS label FROM nreach GROUP BY 1,2",
    "ncomp": "SELECT t, count(*) AS components, max(n) AS largest_cells FROM (SELECT t, label, count(*) AS n FROM nlab GROUP BY 1,2) GROUP BY t",
    "metrics": """SELECT i.t, count(*) AS stream_cells, (SELECT count(*) FROM elinks e WHERE e.t=i.t) AS edges, (SELECT coalesce(sum(len),0e0) FROM elinks e WHERE e.t=i.t)/1e3 AS length_km,
        count(*) FILTER (k=0) AS heads, count(*)-(SELECT count(*) FROM elinks e WHERE e.t=i.t) AS outlets, count(*) FILTER (k>=2) AS junctions FROM inflow i GROUP BY i.t""",
    "rlen": "SELECT sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))/1e3 AS official_km FROM re",
    "rb": "SELECT rc.* FROM rc JOIN basin ON basin.id=rc.id",
    "drb": "SELECT n.t, n.id, sqrt(min((r.row-n.row)*(r.row-n.row)+(r.col-n.col)*(r.col-n.col))) AS dist FROM net n, rb r GROUP BY 1,2",
    "dmo": "SELECT n.t, r.id, sqrt(min((r.row-n.row)*(r.row-n.row)+(r.col-n.col)*(r.col-n.col))) AS dist FROM net n, rb r GROUP BY 1,2",
    "tols": "SELECT unnest([2e0,5e0,10e0]) AS tol",
    "agree": """SELECT a.t, a.tol, a.p, b.r FROM (SELECT t, tol, count(*) FILTER (dist<=tol)/count(*) AS p FROM drb, tols GROUP BY 1,2) a
        JOIN (SELECT t, tol, count(*) FILTER (dist<=tol)/count(*) AS r FROM dmo, tols GROUP BY 1,2) b ON a.t=b.t AND a.tol=b.tol""",
    "sweeps": """SELECT a.t, a.tol, p, r, CASE WHEN p+r=0 THEN 0e0 ELSE 2e0*p*r/(p+r) END AS f1, CASE WHEN 4e0*p+r=0 THEN 0e0 ELSE 5e0*p*r/(4e0*p+r) END AS f2,
        m.length_km, m.length_km/official_km AS length_ratio, abs(m.length_km-official_km) AS length_gap FROM agree a JOIN metrics m ON m.t=a.t, rlen""",
}
SWEEP_CELLS = [50, 100, 200, 400]
# No cell gathers so many, so this threshold has no stream.
NO_STREAM = 1_000_000_000


@query(sql("""SELECT m.t AS threshold, m.stream_cells, m.edges, round(m.length_km,6) AS length_km, m.heads, m.outlets, m.junctions, c.components, c.largest_cells,
    round(c.largest_cells/m.stream_cells,6) AS largest_fraction FROM metrics m JOIN ncomp c ON c.t=m.t""", **SWEEP))
def drainage_network_metrics(spark, sf):
    net = sweep.threshold_networks(fx.flow(spark, sf), fx.acc(spark, sf), SWEEP_CELLS, fx.basin(spark, sf))
    return rounded(hydro.network_metrics(net, fx.grid(spark, sf), ["threshold"]))


@query(sql("SELECT k, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))),6) AS length FROM re GROUP BY k"))
def polyline_length(spark, sf):
    return rounded(vector.line_length(fx.river_edges(spark, sf), ["k"]))


def _agreement(spark, sf, thresholds):
    return sweep.stream_sweep(
        fx.flow(spark, sf), fx.acc(spark, sf), fx.basin(spark, sf), fx.river_cells(spark, sf), fx.river_edges(spark, sf),
        fx.grid(spark, sf), thresholds, [2.0, 5.0, 10.0],
    )


@query(sql("SELECT tol AS tolerance, round(p,6) AS precision_like, round(r,6) AS recall_like, round(f1,6) AS f1, round(f2,6) AS f2 FROM sweeps WHERE t=100", **SWEEP))
def proximity_agreement(spark, sf):
    out = _agreement(spark, sf, [100])
    return rounded(out.select("tolerance", "precision_like", "recall_like", "f1", "f2"))


@query(sql("""SELECT w.t AS threshold, tols.tol AS tolerance, round(coalesce(p,0e0),6) AS precision_like, round(coalesce(r,0e0),6) AS recall_like, round(coalesce(f1,0e0),6) AS f1, round(coalesce(f2,0e0),6) AS f2,
    round(coalesce(length_km,0e0),6) AS length_km, round(coalesce(length_ratio,0e0),6) AS length_ratio, round(coalesce(length_gap,official_km),6) AS length_gap
    FROM (SELECT unnest([50,100,200,400,1000000000]) AS t) w, tols, rlen LEFT JOIN sweeps ON sweeps.t=w.t AND sweeps.tol=tols.tol""", **SWEEP))
def stream_threshold_sweep(spark, sf):
    return rounded(_agreement(spark, sf, [*SWEEP_CELLS, NO_STREAM]))


@query(sql("""SELECT tol AS tolerance, arg_max(t, round(f1,9)*1e6-t) AS best_f1, arg_max(t, round(f2,9)*1e6-t) AS best_f2, arg_min(t, length_gap) AS closest_length FROM sweeps GROUP BY tol""", **SWEEP))
def sweep_leaders(spark, sf):
    return hydro.sweep_leaders(_agreement(spark, sf, SWEEP_CELLS), "threshold")


@query(sql("""SELECT i AS intersection_cells, u AS union_cells, round(i/u,6) AS jaccard, round((SELECT coalesce(count(*) FILTER (d<=5)/nullif(count(*),0),0e0) FROM
      (SELECT a.id, sqrt(min((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))) AS d FROM na a, nb_ b GROUP BY 1)),6) AS a_near_b,
    round((SELECT coalesce(count(*) FILTER (d<=5)/nullif(count(*),0),0e0) FROM (SELECT b.id, sqrt(min((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))) AS d FROM na a, nb_ b GROUP BY 1)),6) AS b_near_a
    FROM (SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS i, count(*) AS u FROM na a FULL JOIN nb_ b ON a.id=b.id)""",
    na="SELECT g.id, g.row, g.col FROM (SELECT cur FROM spaths) s JOIN g ON g.id=s.cur JOIN basin ON basin.id=g.id",
    nb_="SELECT f.id, f.row, f.col FROM flow f JOIN basin ON basin.id=f.id WHERE f.acc>=100", **SEED))
def network_overlap(spark, sf):
    g, basin = fx.grid(spark, sf), fx.basin(spark, sf)
    a = hydro.propagate_downstream(fx.flow(spark, sf), _seeds(spark, sf), g).join(basin, ["row", "col"], "left_semi")
    b = hydro.streams(fx.acc(spark, sf), 100, basin)
    return rounded(sweep.network_overlap(a, b, g, 5.0))
