"""Scene catalogs, radar change and altimetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgrid.functions.projection import ALPHA, lonlat_to_utm, utm_to_lonlat
from floodgrid.functions.rounding import rounded
from floodgrid.operators import altimetry, catalog, sar
from floodgrid.operators.focal import median3
from floodgrid.queries import fixtures as fx
from floodgrid.queries.registry import query
from floodgrid.queries.sqlparts import sql

W = catalog.Windows(
    ("2024-01-01 00:00:00", "2024-01-14 23:59:59"),
    ("2024-01-16 00:00:00", "2024-01-18 23:59:59"),
    ("2024-01-20 00:00:00", "2024-01-28 23:59:59"),
)
KM2 = "69.381334e0/1e6"


def scenes(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 6).cast("int").alias("orbit"),
        F.when(F.col("event_id") % 2 == 0, "ASC").otherwise("DESC").alias("direction"),
        F.col("event_type").alias("pol"), F.col("value").alias("coverage"), catalog.period(F.col("ts"), W).alias("period"),
        F.concat(F.lit("S1"), (F.col("event_id") % 3).cast("string")).alias("platform"), (F.col("user_id") % 4).cast("int").alias("frame"),
    )


@query(sql("SELECT event_id, period FROM scenes"))
def period_bucketing(spark, sf):
    """Times go through text and lenient parsing."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = fx.table(spark, sf, "events").withColumn("t", catalog.parse_time(text))
    return e.select("event_id", catalog.period(F.col("t"), W).alias("period"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'alt-'||event_type END AS scene_name, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS relative_orbit FROM events""")
def catalog_normalisation(spark, sf):
    e = fx.table(spark, sf, "events")
    blank = F.lit("")
    props = F.map_from_arrays(
        F.array(F.lit("sceneName"), F.lit("fileID"), F.lit("pathNumber"), F.lit("relativeOrbit")),
        F.array(
            F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(blank),
            F.concat(F.lit("alt-"), "event_type"),
            blank,
            F.when(F.col("event_id") % 5 == 0, blank).otherwise(F.col("user_id").cast("string")),
        ),
    )
    raw = e.select("event_id", props.alias("props"))
    return catalog.normalise_scenes(raw, "props", {"scene_name": ("sceneName", "fileID"), "relative_orbit": ("pathNumber", "relativeOrbit")})


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN j ELSE 0 END AS item, CASE WHEN event_id % 3 = 2 THEN 0 ELSE j END AS seq, event_type || CAST(j AS VARCHAR) AS name
    FROM events, (SELECT CAST(unnest([0,1]) AS INT) AS j) WHERE event_id % 3 <> 2 OR j < 2""")
def collection_flattening(spark, sf):
    """One collection, a list with one collection, or a list of two single features."""
    feat = lambda j: F.concat(
        F.lit('{"type":"Feature","properties":{"name":"'), F.col("event_type"), F.lit(f'{j}"' + "}}")
    )
    two = F.concat(feat(0), F.lit(","), feat(1))
    coll = F.concat(F.lit('{"type":"FeatureCollection","features":['), two, F.lit("]}"))
    text = (
        F.when(F.col("event_id") % 3 == 0, coll)
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), coll, F.lit("]")))
        .otherwise(F.concat(F.lit("["), two, F.lit("]")))
    )
    docs = fx.table(spark, sf, "events").select("event_id", text.alias("text"))
    out = catalog.flatten_collections(docs, "text", ["event_id"])
    return out.select("event_id", "item", "seq", F.col("properties")["name"].alias("name"))


GRAN = {"gran": """SELECT event_id, ts, lpad(CAST(user_id % 40 AS VARCHAR),4,'0') AS track, lpad(CAST(event_id % 30 AS VARCHAR),2,'0') AS cycle, lpad(CAST(event_id % 14 + 1 AS VARCHAR),2,'0') AS region,
    event_id % 11 <> 0 AS ok FROM events"""}


def granules(spark, sf):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k = F.col("event_id")
    name = F.concat(
        F.when(k % 11 == 0, "ATL99_").otherwise("ATL08_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("_"),
        pad(F.col("user_id") % 40, 4), pad(k % 30, 2), pad(k % 14 + 1, 2), F.lit("_006_01.h5"),
    )
    g = fx.table(spark, sf, "events").select("event_id", "ts", name.alias("granule"))
    track, cycle, region = catalog.parse_granule(F.col("granule"))
    return g.select("event_id", F.col("ts").alias("begin"), "granule", track.alias("track"), cycle.alias("cycle"), region.alias("region"), catalog.period(F.col("ts"), W).alias("period"))


@query(sql("SELECT event_id, CASE WHEN ok THEN track ELSE '' END AS track, CASE WHEN ok THEN cycle ELSE '' END AS cycle, CASE WHEN ok THEN region ELSE '' END AS region FROM gran", **GRAN))
def granule_name_parse(spark, sf):
    return granules(spark, sf).select("event_id", "track", "cycle", "region")


@query(sql("""SELECT a.track, a.region, a.cycle AS pre_cycle, b.cycle AS post_cycle, count(*) AS pairs, round(sum(round((epoch_us(b.ts)-epoch_us(a.ts))/864e8,3)),3) AS total_days FROM gran a JOIN gran b ON a.track=b.track AND a.region=b.region
    JOIN scenes sa ON sa.event_id=a.event_id AND sa.period='PRE' JOIN scenes sb ON sb.event_id=b.event_id AND sb.period='POST' WHERE a.ok AND b.ok GROUP BY 1,2,3,4""", **GRAN))
def repeat_track_pairs(spark, sf):
    """All pairs are counted, and their rounded days summed exactly; none is listed."""
    pairs = catalog.repeat_pairs(granules(spark, sf), sums=True)
    return pairs.withColumn("total_days", F.round("total_days", 3))


@query(sql("SELECT orbit, period, count(*) AS scenes FROM scenes GROUP BY 1,2"))
def scene_period_counts(spark, sf):
    return catalog.period_counts(scenes(spark, sf), ["orbit"])


@query(sql("SELECT DISTINCT pol FROM scenes"))
def distinct_catalog_values(spark, sf):
    return catalog.distinct_sorted(scenes(spark, sf), "pol")


@query(sql(f"SELECT k, round(count(*)*{KM2},6) AS covered_km2, round(1e2*count(*)/(SELECT count(*) FROM basin),6) AS coverage_pct FROM zc JOIN basin ON basin.id=zc.id GROUP BY k"))
def footprint_coverage(spark, sf):
    return rounded(catalog.footprint_coverage(fx.zone_cells(spark, sf), fx.basin(spark, sf), "k", fx.CELL_AREA))


@query(sql(f"""SELECT round(u*{KM2},6) AS union_km2, round(1e2*u/(SELECT count(*) FROM basin),6) AS union_pct FROM (SELECT count(DISTINCT zn.id) AS u FROM zn JOIN basin ON basin.id=zn.id)"""))
def footprint_union_coverage(spark, sf):
    z = fx.named_zone_cells(spark, sf)
    return rounded(catalog.union_coverage(z, fx.basin(spark, sf), fx.CELL_AREA))


@query(sql("""SELECT count(*) AS scenes, count(DISTINCT CAST(ts AS DATE)) AS dates, min(coverage) AS min_coverage, max(coverage) AS max_coverage, count(DISTINCT pol) AS distinct_pol, count(DISTINCT direction) AS distinct_direction FROM scenes"""))
def scene_attribute_ranges(spark, sf):
    return catalog.attribute_ranges(scenes(spark, sf), "ts", ["coverage"], ["pol", "direction"])


@query(sql("""SELECT direction, orbit, pol, arg_max(event_id, epoch_us(ts)) FILTER (period='PRE') AS pre_scene, max(ts) FILTER (period='PRE') AS pre_time,
    arg_min(event_id, abs(epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-18 23:59:59'))) FILTER (period='EVENT') AS event_scene, arg_min(ts, abs(epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-18 23:59:59'))) FILTER (period='EVENT') AS event_time,
    arg_min(event_id, epoch_us(ts)) FILTER (period='POST') AS post_scene, min(ts) FILTER (period='POST') AS post_time FROM scenes GROUP BY 1,2,3
    HAVING count(*) FILTER (period='EVENT')>0 AND count(*) FILTER (period IN ('PRE','POST'))>0"""))
def closest_scene_triplets(spark, sf):
    return catalog.closest_triplets(scenes(spark, sf), ["direction", "orbit", "pol"], W, "event_id", "ts")


TRIP = {
    "sc": """SELECT s.*, 'S1'||CAST(s.event_id % 3 AS VARCHAR) AS platform, CAST(user_id % 4 AS VARCHAR) AS frame,
        abs(epoch_us(s.ts)-epoch_us(CASE period WHEN 'PRE' THEN TIMESTAMP '2024-01-16 00:00:00' WHEN 'EVENT' THEN TIMESTAMP '2024-01-18 23:59:59' ELSE TIMESTAMP '2024-01-20 00:00:00' END))/36e8 AS away
        FROM scenes s JOIN events e ON e.event_id=s.event_id WHERE period IN ('PRE','EVENT','POST')""",
    "sf": "SELECT sc.*, TRUE AS wf, frame AS fr FROM sc UNION ALL SELECT sc.*, FALSE, '' FROM sc",
    "pk": "SELECT * FROM sf QUALIFY row_number() OVER (PARTITION BY direction, orbit, pol, wf, fr, period ORDER BY coverage DESC, away, event_id)=1",
    "tr": """SELECT a.direction, a.orbit, a.pol, a.wf, a.fr, a.event_id AS pre_scene, b.event_id AS event_scene, c.event_id AS post_scene, least(a.coverage,b.coverage,c.coverage) AS lowc, (a.coverage+b.coverage+c.coverage)/3e0 AS meanc,
        a.platform=b.platform AND b.platform=c.platform AS same, a.away+b.away+c.away AS away FROM pk a JOIN pk b ON a.direction=b.direction AND a.orbit=b.orbit AND a.pol=b.pol AND a.wf=b.wf AND a.fr=b.fr
        JOIN pk c ON a.direction=c.direction AND a.orbit=c.orbit AND a.pol=c.pol AND a.wf=c.wf AND a.fr=c.fr WHERE a.period='PRE' AND b.period='EVENT' AND c.period='POST'""",
    "ts_": "SELECT *, lowc*1000+meanc*10-away+CASE WHEN same THEN 25 ELSE 0 END+CASE WHEN wf THEN 10 ELSE 0 END AS score FROM tr",
    "td": "SELECT * FROM ts_ QUALIFY row_number() OVER (PARTITION BY pre_scene, event_scene, post_scene ORDER BY score DESC)=1",
    "rk_": "SELECT row_number() OVER (ORDER BY score DESC, pre_scene, event_scene, post_scene) AS rank, * FROM td",
}


def _triplets(spark, sf):
    return catalog.ranked_triplets(scenes(spark, sf), ["direction", "orbit", "pol"], "frame", W, "event_id", "ts")


@query(sql("""SELECT rank, direction, orbit, pol, wf AS with_frame, fr AS frame, same AS same_platform, lowc AS min_coverage, round(meanc,6) AS mean_coverage, round(score,4) AS score, pre_scene, event_scene, post_scene FROM rk_""", **TRIP))
def ranked_scene_triplets(spark, sf):
    return _triplets(spark, sf).select(
        "rank", "direction", "orbit", "pol", "with_frame", "frame", "same_platform", "min_coverage", F.round("mean_coverage", 6).alias("mean_coverage"),
        F.round("score", 4).alias("score"), "pre_scene", "event_scene", "post_scene",
    )


@query(sql("""SELECT rank, m.role, m.scene, sc.ts AS time, sc.coverage, sc.platform FROM (SELECT rank, 'PRE' AS role, pre_scene AS scene FROM rk_ UNION ALL SELECT rank, 'EVENT', event_scene FROM rk_
    UNION ALL SELECT rank, 'POST', post_scene FROM rk_) m JOIN sc ON sc.event_id=m.scene""", **TRIP))
def selected_scene_manifest(spark, sf):
    return catalog.scene_manifest(_triplets(spark, sf), ["rank"])


@query("""SELECT l_orderkey, count(*) FILTER (k='VV') AS vv, count(*) FILTER (k='VH') AS vh, count(*) FILTER (k='INC') AS inc, count(*) FILTER (k='LS') AS ls, count(*) FILTER (k='OTHER') AS other,
    count(*) FILTER (k='VV')=1 AND count(*) FILTER (k='VH')=1 AS usable FROM (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'VV' WHEN 2 THEN 'VH' WHEN 3 THEN 'INC' WHEN 4 THEN 'LS' ELSE 'OTHER' END AS k FROM lineitem) GROUP BY 1""")
def radar_layer_classification(spark, sf):
    # Endings of test file names.
    ends = {1: "_VV.tif", 2: "-vh_x.tif", 3: "_inc_map.tif", 4: "_ls_map.tif"}
    tail = F.lit("_rgb.tif")
    for k, v in ends.items():
        tail = F.when(F.col("l_linenumber") == k, v).otherwise(tail)
    files = fx.table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("S1_"), F.col("l_orderkey").cast("string"), tail).alias("name"))
    return sar.layer_check(files, "l_orderkey", "name")


# Names whose parts run together, end early, or fit several kinds.
LAYER_NAMES = [
    "S1A_{}_VV.tif", "vv-{}.tif", "a{}.vv.tif", "S1A_{}_localincangle.tif", "S1_inc_mapped_{}.tif", "my{}_incidence-angle2.tif", "S1_{}_ls_map.tif",
    "lsmap_{}.tif", "{}_LayoverMask.tif", "rgb_{}.tif", "S1_vvh_{}.tif", "{}-VH_inc_map.tif", "since_{}.tif", "shadow_{}_vh",
]
NAMED = "(SELECT l_orderkey, replace(list_extract([" + ", ".join(f"'{n}'" for n in LAYER_NAMES) + f"], CAST((l_orderkey + l_linenumber) % {len(LAYER_NAMES)} + 1 AS INT)), '{{}}', CAST(l_partkey AS VARCHAR)) AS name FROM lineitem)"


@query(f"""SELECT name, CASE WHEN regexp_matches(lower(name), '(^|_|-)vv(_|[.]|-|$)') THEN 'VV' WHEN regexp_matches(lower(name), '(^|_|-)vh(_|[.]|-|$)') THEN 'VH'
    WHEN lower(name) LIKE '%inc%' AND (lower(name) LIKE '%map%' OR lower(name) LIKE '%angle%') THEN 'INC'
    WHEN contains(lower(name), 'ls_map') OR lower(name) LIKE '%layover%' OR lower(name) LIKE '%shadow%' THEN 'LS' ELSE 'OTHER' END AS kind, count(*) AS files FROM {NAMED} GROUP BY 1, 2""")
def radar_layer_names(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    pick = F.element_at(F.array(*[F.lit(n) for n in LAYER_NAMES]), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(LAYER_NAMES) + 1).cast("int"))
    names = lines.select(F.replace(pick, F.lit("{}"), F.col("l_partkey").cast("string")).alias("name"))
    return names.groupBy("name", sar.layer_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("files"))


def line_role():
    """The acquisition that an order line stands for."""
    n = F.col("l_linenumber") % 3
    return F.when(n == 1, "PRE").when(n == 2, "EVENT").otherwise("POST")


LAYERS = [f"{r}_{p}" for r in ("PRE", "EVENT", "POST") for p in ("VV", "VH")]


@fx.shared
def sar_wide(spark, sf):
    """A row per cell with the decibels of its layers, from all order lines."""
    k = F.col("l_orderkey")
    lines = fx.table(spark, sf, "lineitem").select(
        F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"), line_role().alias("role"),
        F.col("l_extendedprice").alias("VV"), F.col("l_quantity").alias("VH"),
    )
    full = {"VV": 1e5, "VH": 1e2}
    db = [F.round(sar.to_db(F.col(n) / full[n.split("_")[1]]), 9).alias(n) for n in LAYERS]
    return sar.wide(lines, LAYERS).select("row", "col", *db).where(F.coalesce(*LAYERS).isNotNull())


def sar_layers(spark, sf):
    """(row, col, role, pol, db) from all order lines."""
    return sar.long(sar_wide(spark, sf), LAYERS)


@fx.shared
def sar_filtered(spark, sf):
    """A row per basin cell with its layers as they are (RAW_) and filtered."""
    return median3(sar_wide(spark, sf), fx.basin(spark, sf), LAYERS, own="RAW_")


def _in_basin(spark, sf, layers):
    return layers.join(fx.basin(spark, sf), ["row", "col"], "left_semi")


def _raw_cells(cells, *keep):
    return cells.select("row", "col", *keep, *[F.col(f"RAW_{n}").alias(n) for n in LAYERS])


def _raw_changes(cells, keep=()):
    return sar.ratios_and_changes(_raw_cells(cells, *keep), "RAW", keep)


def _all_changes(cells, keep=()):
    return _raw_changes(cells, keep).unionByName(sar.ratios_and_changes(cells, "MED3", keep))


def sar_changes(spark, sf):
    return _all_changes(sar_filtered(spark, sf))


LONG = """SELECT id, role, 'VV' AS pol, vv AS db FROM sar UNION ALL SELECT id, role, 'VH', vh FROM sar"""
SAR = {
    "lay": LONG,
    "layb": "SELECT l.* FROM lay l JOIN basin b ON b.id=l.id",
    "bas": "SELECT g.id, g.row, g.col FROM g JOIN basin ON basin.id=g.id",
    "med": """SELECT b.id, l.role, l.pol, quantile_cont(l.db,0.5) AS db FROM bas b, (SELECT unnest([-1,0,1]) AS dr) r, (SELECT unnest([-1,0,1]) AS dc) c JOIN g n ON n.row=b.row+r.dr AND n.col=b.col+c.dc
        JOIN lay l ON l.id=n.id GROUP BY 1,2,3""",
    "bth": "SELECT 'RAW' AS mode, * FROM layb UNION ALL SELECT 'MED3', * FROM med",
    "rat": "SELECT a.mode, a.id, a.role, 'VHminusVV' AS pol, a.db-b.db AS db FROM bth a JOIN bth b ON a.mode=b.mode AND a.id=b.id AND a.role=b.role WHERE a.pol='VH' AND b.pol='VV'",
    "allv": "SELECT mode, id, role, pol, db FROM bth UNION ALL SELECT * FROM rat",
    "cmp": "SELECT * FROM (VALUES ('EVENT_MINUS_PRE','EVENT','PRE'),('POST_MINUS_PRE','POST','PRE'),('POST_MINUS_EVENT','POST','EVENT')) c(comparison,later,earlier)",
    "chg": """SELECT c.comparison, a.pol AS variable, a.mode, a.id, a.db-b.db AS value FROM cmp c JOIN allv a ON a.role=c.later JOIN allv b ON b.role=c.earlier AND a.mode=b.mode AND a.id=b.id AND a.pol=b.pol""",
    "dom": "SELECT id FROM layb GROUP BY id HAVING count(DISTINCT role||pol)=6",
    "zf": """SELECT d.id, o.id IS NOT NULL AS o, p.id IS NOT NULL AS p FROM dom d LEFT JOIN obs o ON o.id=d.id LEFT JOIN (SELECT id FROM hc WHERE scenario='P175') p ON p.id=d.id""",
    "zz": """SELECT 'COMMON_VALID' AS zone, id FROM zf UNION ALL SELECT 'OBSERVED', id FROM zf WHERE o UNION ALL SELECT 'NON_OBSERVED', id FROM zf WHERE NOT o UNION ALL SELECT 'PREDICTED', id FROM zf WHERE p
        UNION ALL SELECT 'TP', id FROM zf WHERE o AND p UNION ALL SELECT 'FN', id FROM zf WHERE o AND NOT p UNION ALL SELECT 'PREDICTED_ONLY', id FROM zf WHERE p AND NOT o""",
    "cz_": "SELECT chg.*, zone FROM chg JOIN zz ON zz.id=chg.id",
}
DIST = "count(v) AS n, round(min(v),6) AS min, round(avg(v),6) AS mean, round(max(v),6) AS max, round(stddev_pop(v),6) AS std, " + ", ".join(
    f"round(quantile_cont(v,{p}),6) AS {n}" for n, p in sar.PROBS.items()
)
SIGNS = ", round(1e2*count(*) FILTER (v<0)/count(v),6) AS negative_pct, round(1e2*count(*) FILTER (v>0)/count(v),6) AS positive_pct"


@query(sql("SELECT CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col, role, pol, round(db,6) AS db FROM lay", **SAR))
def power_to_decibel(spark, sf):
    return rounded(sar_layers(spark, sf))


@query(sql("SELECT comparison, variable, mode, CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col, value FROM chg", **SAR))
def temporal_differences(spark, sf):
    return sar_changes(spark, sf)


@query(sql(f"SELECT comparison, variable, mode, {DIST} FROM (SELECT *, value AS v FROM chg) GROUP BY 1,2,3", **SAR))
def layer_distributions(spark, sf):
    return rounded(sar.distribution(sar_changes(spark, sf), ["comparison", "variable", "mode"]))


@query(sql("SELECT CAST(id//100 AS INT) AS row, CAST(id%100 AS INT) AS col FROM dom", **SAR))
def common_valid_domain(spark, sf):
    return _in_basin(spark, sf, sar.common_domain(sar_wide(spark, sf), LAYERS))


@query(sql(f"SELECT role, pol, count(*) AS cells, round(count(*)*{KM2},6) AS area_km2 FROM layb GROUP BY 1,2", **SAR))
def layer_valid_areas(spark, sf):
    return rounded(sar.layer_areas(sar_layers(spark, sf), fx.basin(spark, sf), fx.CELL_AREA))


def _predicted(spark, sf):
    return fx.hazard(spark, sf).where("scenario = 'P175'")


@fx.shared
def sar_zones(spark, sf):
    dom = _in_basin(spark, sf, sar.common_domain(sar_wide(spark, sf), LAYERS))
    return sar.derived_zones(dom, fx.observed(spark, sf), _predicted(spark, sf))


@query(sql(f"SELECT zone, count(*) AS cells, round(count(*)*{KM2},6) AS area_km2 FROM zz GROUP BY 1", **SAR))
def derived_zone_areas(spark, sf):
    return rounded(sar.zone_areas(sar_zones(spark, sf), fx.CELL_AREA))


@query(sql("""SELECT mask, count(*) AS full_cells, count(d.id) AS kept_cells, round(1e2*count(d.id)/count(*),6) AS kept_pct FROM (SELECT 'OBSERVED' AS mask, id FROM obs UNION ALL SELECT 'P175', id FROM hc WHERE scenario='P175') m
    LEFT JOIN dom d ON d.id=m.id GROUP BY 1""", **SAR))
def reference_retention(spark, sf):
    dom = _in_basin(spark, sf, sar.common_domain(sar_wide(spark, sf), LAYERS))
    return rounded(sar.retention({"OBSERVED": fx.observed(spark, sf), "P175": _predicted(spark, sf)}, dom))


def _raw_by_zone(spark, sf, keys):
    # The columns that the raw changes need.
    cells = sar_filtered(spark, sf).select("row", "col", *[f"RAW_{n}" for n in LAYERS])
    return sar.by_zone(cells, _raw_changes, sar_zones(spark, sf), keys)


@query(sql(f"SELECT comparison, variable, zone, {DIST}{SIGNS} FROM (SELECT *, value AS v FROM cz_ WHERE mode='RAW') GROUP BY 1,2,3", **SAR))
def layer_zone_distributions(spark, sf):
    return rounded(_raw_by_zone(spark, sf, ["comparison", "variable"]))


CONTRAST = {
    "zs": "SELECT comparison, variable, mode, zone, quantile_cont(value,0.5) AS md, quantile_cont(value,0.05) AS lo, quantile_cont(value,0.95) AS hi, 1e2*count(*) FILTER (value<0)/count(*) AS neg FROM cz_ GROUP BY 1,2,3,4",
    "zp": """SELECT comparison, variable, mode, max(md) FILTER (zone='OBSERVED') AS om, max(md) FILTER (zone='NON_OBSERVED') AS nm, max(md) FILTER (zone='TP') AS tm, max(md) FILTER (zone='FN') AS fm,
        max(lo) FILTER (zone='OBSERVED') AS olo, max(hi) FILTER (zone='OBSERVED') AS ohi, max(lo) FILTER (zone='FN') AS flo, max(hi) FILTER (zone='FN') AS fhi, max(neg) FILTER (zone='OBSERVED') AS oneg, max(neg) FILTER (zone='NON_OBSERVED') AS nneg FROM zs GROUP BY 1,2,3""",
}
CCOLS = """round(om,6) AS observed_median, round(nm,6) AS non_observed_median, round(tm,6) AS tp_median, round(fm,6) AS fn_median, round(olo,6) AS observed_p05, round(ohi,6) AS observed_p95, round(flo,6) AS fn_p05, round(fhi,6) AS fn_p95,
    round(oneg,6) AS observed_negative_pct, round(nneg,6) AS non_observed_negative_pct, round(om-nm,6) AS observed_minus_non_observed, round(fm-tm,6) AS fn_minus_tp"""


@query(sql(f"SELECT comparison, variable, {CCOLS} FROM zp WHERE mode='RAW'", **SAR, **CONTRAST))
def zone_contrast_table(spark, sf):
    keys = ["comparison", "variable"]
    return rounded(sar.zone_contrasts(_raw_by_zone(spark, sf, keys), keys))


@query(sql(f"SELECT comparison, variable, mode, {CCOLS} FROM zp", **SAR, **CONTRAST))
def filter_sensitivity(spark, sf):
    keys = ["comparison", "variable", "mode"]
    return rounded(sar.zone_contrasts(sar.by_zone(sar_filtered(spark, sf), _all_changes, sar_zones(spark, sf), keys), keys))


@query(sql(f"""SELECT comparison, {DIST} FROM (SELECT c.comparison, a.a-b.a AS v FROM cmp c JOIN incd a ON a.role=c.later JOIN incd b ON b.role=c.earlier AND a.id=b.id) GROUP BY 1""",
    incd="SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 1 THEN 'PRE' WHEN 2 THEN 'EVENT' ELSE 'POST' END AS role, max(3e1+l_tax*1e2) AS a FROM lineitem GROUP BY 1,2", **SAR))
def incidence_angle_comparability(spark, sf):
    k = F.col("l_orderkey")
    role = line_role()
    angle = fx.table(spark, sf, "lineitem").groupBy(k.alias("id"), role.alias("role")).agg(F.max(30.0 + F.col("l_tax") * 100.0).alias("a"))
    return rounded(sar.distribution(sar.role_differences(angle, ["id"], "a"), ["comparison"]))


# --- altimetry ---

PT = "SELECT point_id, beam, date, x, y, x/1e1+2e1 AS h, CASE WHEN x>0 THEN y/1e2 END AS canopy FROM pts"


def _points(spark, sf):
    return fx.points(spark, sf).withColumn("h", F.col("x") / 10.0 + 20.0).withColumn("canopy", F.when(F.col("x") > 0, F.col("y") / 100.0))


@query(sql("""SELECT date, beam, count(*) AS points, round(min(x),6) AS xmin, round(min(y),6) AS ymin, round(max(x),6) AS xmax, round(max(y),6) AS ymax, round(min(h),6) AS h_min, round(quantile_cont(h,0.5),6) AS h_median,
    round(max(h),6) AS h_max, count(canopy) AS canopy_valid, round(min(canopy),6) AS canopy_min, round(quantile_cont(canopy,0.5),6) AS canopy_median, round(max(canopy),6) AS canopy_max FROM pt_ GROUP BY 1,2""", pt_=PT))
def point_group_summary(spark, sf):
    return rounded(altimetry.point_summary(_points(spark, sf), ["date", "beam"]))


NN = {"nn": "SELECT a.beam, a.date, a.point_id, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM pts a JOIN pts b ON a.beam=b.beam AND a.date<>b.date GROUP BY 1,2,3"}
STEPS = [10, 20, 30, 50, 75, 100, 150, 200, 500]


@query(sql("SELECT beam, date, count(*) AS points, round(min(d),6) AS min_dist, round(quantile_cont(d,0.5),6) AS median_dist, round(quantile_cont(d,0.95),6) AS p95_dist, round(max(d),6) AS max_dist, "
    + ", ".join(f"round(1e2*count(*) FILTER (d<={t})/count(*),6) AS within_{t}" for t in STEPS) + " FROM nn GROUP BY 1,2", **NN))
def nearest_neighbour_between_dates(spark, sf):
    d = altimetry.nearest_distances(fx.points(spark, sf), "beam", 20.0)
    return rounded(altimetry.nearest_summary(d, ["beam", "date"], STEPS))


@query("""SELECT CAST(user_id AS INT) AS beam, CASE WHEN bool_or(event_type='click') AND bool_or(event_type<>'click') THEN 'common' WHEN bool_or(event_type='click') THEN 'pre_only' ELSE 'post_only' END AS presence
    FROM events GROUP BY 1""")
def beam_set_comparison(spark, sf):
    e = fx.table(spark, sf, "events")
    p = e.select(F.col("user_id").cast("int").alias("beam"), F.when(F.col("event_type") == "click", "PRE").otherwise("POST").alias("date"))
    return altimetry.beam_sets(p)


def _period_flags(name, source):
    pre, post = (f"coalesce((SELECT bool_or(period='{p}') FROM {source}), FALSE)" for p in ("PRE", "POST"))
    return f"{pre} AS {name}_pre, {post} AS {name}_post, {pre} AND {post} AS {name}_pre_and_post"


@query(sql(f"""SELECT {_period_flags("radar", "asc_")}, {_period_flags("optical", "desc_")}, {_period_flags("granule", "scenes")},
    coalesce((SELECT bool_or(coverage>0) FROM desc_), FALSE) AS optical_meets_area,
    EXISTS (SELECT 1 FROM gran a JOIN gran b ON a.track=b.track AND a.region=b.region JOIN scenes sa ON sa.event_id=a.event_id AND sa.period='PRE' JOIN scenes sb ON sb.event_id=b.event_id AND sb.period='POST' WHERE a.ok AND b.ok) AS repeat_elevation_candidate""",
    asc_="SELECT * FROM scenes WHERE direction='ASC'", desc_="SELECT * FROM scenes WHERE direction='DESC'", **GRAN))
def source_verdict(spark, sf):
    s = scenes(spark, sf)
    g = granules(spark, sf)
    return catalog.source_verdict(s.where("direction = 'ASC'"), s.where("direction = 'DESC'"), g, catalog.repeat_pairs(g))


# JSON documents written from the events: two rows each, one of them damaged now and then.
DOC = """SELECT event_id, j AS row_index, CASE WHEN j=0 THEN -9e-1+CAST(user_id % 97 AS DOUBLE)/1e3 ELSE -85e-2 END AS lat, CASE WHEN j=0 THEN 1004e-1+CAST(event_id % 50 AS DOUBLE)/1e2 ELSE 1003e-1 END AS lon,
    CASE WHEN j=0 THEN value ELSE 5e0 END AS h, CASE WHEN j=0 AND event_id % 4=0 THEN NULL WHEN j=0 THEN 2e0 ELSE 3e0 END AS canopy, user_id, j FROM events, (SELECT CAST(unnest([0,1]) AS INT) AS j)
    WHERE NOT (j=1 AND event_id % 7=0) AND NOT (j=0 AND event_id % 9=0)"""


def _documents(spark, sf):
    k = F.col("event_id")
    num = lambda c: c.cast("string")
    lat = -0.9 + (F.col("user_id") % 97).cast("double") / 1e3
    lon = 100.4 + (k % 50).cast("double") / 1e2
    canopy = F.when(k % 4 == 0, '"NaN"').otherwise("2.0")
    h = F.when(k % 9 == 0, '"n/a"').otherwise(num(F.col("value")))
    first = F.concat(F.lit("["), num(lat), F.lit(","), num(lon), F.lit(","), h, F.lit(","), canopy, F.lit("]"))
    second = F.when(k % 7 == 0, "[-0.85,100.3]").otherwise("[-0.85,100.3,5.0,3.0]")
    text = F.concat(F.lit('{"series":[{"lat_lon_elev_canopy":['), first, F.lit(","), second, F.lit("]}]}"))
    return fx.table(spark, sf, "events").select("event_id", text.alias("text"))


@query(sql("SELECT event_id, 0 AS series_index, row_index, lat, lon, h, canopy FROM docs WHERE lon <= 1006e-1", docs=DOC))
def nested_json_rows(spark, sf):
    p = altimetry.parse_series(_documents(spark, sf), "text", ["event_id"], (100.3, -1.0, 100.6, -0.7))
    return p.select("event_id", "series_index", "row_index", "lat", "lon", "h", "canopy")


UTM_T = "sinh(atanh(sin(phi)) - {e}*atanh({e}*sin(phi)))"


def _utm_sql():
    from floodgrid.functions import projection as pj
    import math

    e = 2 * math.sqrt(pj._N) / (1 + pj._N)
    k = pj.SCALE * pj._A
    es = "".join(f"+({a!r})*cos(2e0*{j}*xi)*sinh(2e0*{j}*eta)" for j, a in enumerate(ALPHA, 1))
    ns = "".join(f"+({a!r})*sin(2e0*{j}*xi)*cosh(2e0*{j}*eta)" for j, a in enumerate(ALPHA, 1))
    return f"""WITH a AS (SELECT c_custkey, radians(-c_acctbal/5e3) AS phi, radians((97e0+c_nationkey/1e1)-99e0) AS lam, 97e0+c_nationkey/1e1 AS lon, -c_acctbal/5e3 AS lat FROM customer),
      b AS (SELECT *, {UTM_T.format(e=repr(e))} AS t FROM a), c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1e0+t*t)) AS eta FROM b)
      SELECT c_custkey, round(5e5+{k!r}*(eta{es}),4) AS x, round(1e7+{k!r}*(xi{ns}),4) AS y, round(lon,7) AS lon_back, round(lat,7) AS lat_back FROM c"""


@query(_utm_sql())
def utm_projection_round_trip(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", (97.0 + F.col("c_nationkey") / 10.0).alias("lon"), (-F.col("c_acctbal") / 5e3).alias("lat"))
    x, y = lonlat_to_utm(F.col("lon"), F.col("lat"))
    p = c.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = utm_to_lonlat(F.col("x"), F.col("y"))
    return p.select("c_custkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 7).alias("lon_back"), F.round(lat, 7).alias("lat_back"))


@query("""SELECT c_mktsegment AS track, 1 AS lat_index, 0 AS lon_index, 2 AS height_index, avg(CASE WHEN -c_acctbal/1e4 BETWEEN -2 AND 1 THEN 1e0 ELSE 0e0 END) AS lat_score, 1e0 AS lon_score, 1e0 AS height_score
    FROM customer GROUP BY 1""")
def column_role_inference(spark, sf):
    rows = fx.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("track"),
        F.array(F.lit(99.5) + F.col("c_nationkey") / 100.0, -F.col("c_acctbal") / 1e4, F.lit(50.0) + F.col("c_acctbal") / 1e3).alias("vals"),
    )
    return altimetry.column_roles(rows, ["track"], "vals")


@query("""SELECT 'kind' AS section, 'dict' AS name, count(*)*1e0 AS value FROM events UNION ALL SELECT 'kind', 'int', count(*)*1e0 FROM events UNION ALL SELECT 'key', 'k', count(*)*1e0 FROM events UNION ALL SELECT 'depth','max',2e0
    UNION ALL SELECT 'kind', 'list', count(*)*1e0 FROM events UNION ALL SELECT 'kind', 'float', count(*)*2e0 FROM events UNION ALL SELECT 'kind','dict_extra',0e0 WHERE FALSE UNION ALL SELECT 'key', 'p', count(*)*1e0 FROM events UNION ALL SELECT 'key', 'gt1L', count(*)*1e0 FROM events UNION ALL SELECT 'top_key', 'p', count(*)*1e0 FROM events UNION ALL SELECT 'top_key', 'gt1L', count(*)*1e0 FROM events UNION ALL SELECT 'beam_path', '$.gt1L', count(*)*1e0 FROM events
    UNION ALL SELECT 'list_length', 'count', count(*)*1e0 FROM events UNION ALL SELECT 'list_length', unnest(['min','median','max']), 2e0""".replace("SELECT 'kind' AS section, 'dict' AS name, count(*)*1e0 AS value", "SELECT 'kind' AS section, 'dict' AS name, count(*)*2e0 AS value"))
def json_tree_summary(spark, sf):
    text = F.concat(F.lit('{"p":'), "props", F.lit(',"gt1L":[0.5,1.25]}'))
    docs = fx.table(spark, sf, "events").select("event_id", text.alias("text"))
    return altimetry.json_tree_summary(docs, "text", ["event_id"])


@query("""WITH d AS (SELECT s_suppkey, 30 + s_suppkey % 20 AS n FROM supplier)
    SELECT 'kind' AS section, 'list' AS name, sum(n)*1e0 AS value FROM d WHERE s_suppkey % 7 <> 3 UNION ALL SELECT 'kind', 'int', count(*)*1e0 FROM d WHERE s_suppkey % 7 <> 3
    UNION ALL SELECT 'kind', 'broken', count(*)*1e0 FROM d WHERE s_suppkey % 7 = 3 UNION ALL SELECT 'depth', 'max', max(n)*1e0 FROM d WHERE s_suppkey % 7 <> 3
    UNION ALL SELECT 'list_length', 'count', sum(n)*1e0 FROM d WHERE s_suppkey % 7 <> 3 UNION ALL SELECT 'list_length', unnest(['min','median','max']), 1e0""")
def json_deep_trees(spark, sf):
    """Lists in lists, 30 to 49 deep; every seventh text is cut off."""
    n = (30 + F.col("s_suppkey") % 20).cast("int")
    text = F.concat(F.repeat(F.lit("["), n), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 7 == 3, "").otherwise(F.repeat(F.lit("]"), n)))
    docs = fx.table(spark, sf, "supplier").select("s_suppkey", text.alias("text"))
    return altimetry.json_tree_summary(docs, "text", ["s_suppkey"])


@query("""SELECT event_id, '$.pts' AS path, 'UNKNOWN' AS beam, 'dict_rows' AS kind, CAST(2 AS BIGINT) AS rows, CAST(NULL AS INT) AS shortest, CAST(NULL AS INT) AS longest FROM events UNION ALL SELECT event_id, '$.GT2r', 'gt2r', 'numeric_rows', 2, 3, 4 FROM events WHERE event_id % 2 = 0""")
def candidate_point_arrays(spark, sf):
    return altimetry.candidate_arrays(_point_documents(spark, sf), "text", ["event_id"])


@query("""SELECT event_id, '$.pts' AS path, 'UNKNOWN' AS beam, 'dict_rows' AS kind, 0 AS row_index, 1e0 AS lat, 2e0 AS lon, 3e0 AS height FROM events UNION ALL
    SELECT event_id, '$.GT2r', 'gt2r', 'numeric_rows', j, CASE j WHEN 0 THEN -9e-1 ELSE -8e-1 END, CASE j WHEN 0 THEN 1004e-1 ELSE 1005e-1 END, CASE j WHEN 0 THEN value ELSE 12e0 END FROM events, (SELECT CAST(unnest([0,1]) AS INT) AS j) WHERE event_id % 2 = 0""")
def candidate_point_extraction(spark, sf):
    return altimetry.extract_points(_point_documents(spark, sf), "text", ["event_id"])


def _point_documents(spark, sf):
    v = F.col("value").cast("string")
    nums = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[[-0.9,100.4,"), v, F.lit("],[-0.8,100.5,12.0,1.5]]"))).otherwise("[[1.0],[2.0]]")
    text = F.concat(F.lit('{"pts":[{"Lat_ph":1,"segment_lon":2,"h_te_interp":3},{"lat_ph":4}],"GT2r":'), nums, F.lit("}"))
    return fx.table(spark, sf, "events").select("event_id", text.alias("text"))
