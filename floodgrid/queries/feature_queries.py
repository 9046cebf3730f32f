"""Feature documents, topology, snapshots, export shaping and map data."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodgrid.functions.rounding import rounded
from floodgrid.operators import cartodata, snapshot, topology, vector
from floodgrid.queries import fixtures as fx
from floodgrid.queries.registry import query
from floodgrid.queries.scene_queries import SAR, sar_changes
from floodgrid.queries.sqlparts import sql
from floodgrid.sources import features as feat
from floodgrid.sources import tables

S = lambda c: F.col(c).cast("string")


def _supplier_collections(spark, sf):
    """A collection per supplier: a square, a point and a feature without geometry."""
    k, n = S("s_suppkey"), S("s_nationkey")
    sq = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"'), k, F.lit('","kind":"area"},"geometry":{"type":"Polygon","coordinates":[[['),
        k, F.lit(","), n, F.lit("],["), S("e"), F.lit(","), n, F.lit("],["), S("e"), F.lit(","), S("f"), F.lit("],["), k, F.lit(","), S("f"), F.lit("],["), k, F.lit(","), n, F.lit("]]]}}"),
    )
    pt = F.concat(F.lit('{"type":"Feature","properties":{"id":"'), k, F.lit('","kind":"spot"},"geometry":{"type":"Point","coordinates":['), k, F.lit(","), n, F.lit("]}}"))
    none = F.lit('{"type":"Feature","properties":{},"geometry":null}')
    both = F.concat(
        F.lit('{"type":"Feature","properties":{"kind":"both"},"geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":['), k, F.lit(","), n,
        F.lit(']},{"type":"LineString","coordinates":[[0,0],['), k, F.lit(","), n, F.lit("]]}]}}"),
    )
    # Every ninth text is cut off.
    end = F.when(F.col("s_suppkey") % 9 == 4, "").otherwise("]}")
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), sq, F.lit(","), none, F.lit(","), pt, F.lit(","), both, end)
    s = fx.table(spark, sf, "supplier").withColumn("e", F.col("s_suppkey") + 2).withColumn("f", F.col("s_nationkey") + 3)
    return s.select("s_suppkey", text.alias("text"))


@query("""SELECT s_suppkey, j AS feature_id, CASE j WHEN 0 THEN 'Polygon' ELSE 'Point' END AS kind, CASE j WHEN 0 THEN 'area' ELSE 'spot' END AS label, s_suppkey*1e0 AS xmin, s_nationkey*1e0 AS ymin,
    CASE j WHEN 0 THEN s_suppkey+2e0 ELSE s_suppkey*1e0 END AS xmax, CASE j WHEN 0 THEN s_nationkey+3e0 ELSE s_nationkey*1e0 END AS ymax, NULL AS issue FROM supplier, (SELECT CAST(unnest([0,2]) AS INT) AS j) WHERE s_suppkey % 9 <> 4
    UNION ALL SELECT s_suppkey, 3, k, 'both', CASE k WHEN 'Point' THEN s_suppkey ELSE least(s_suppkey, 0) END*1e0, CASE k WHEN 'Point' THEN s_nationkey ELSE 0 END*1e0, s_suppkey*1e0, s_nationkey*1e0, NULL
    FROM supplier, (SELECT unnest(['Point','LineString']) AS k) WHERE s_suppkey % 9 <> 4
    UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'broken document' FROM supplier WHERE s_suppkey % 9 = 4""")
def geojson_features(spark, sf):
    f = feat.parse_features(_supplier_collections(spark, sf), "text", ["s_suppkey"])
    good = f.where("issue is null").withColumn("label", F.col("properties")["kind"])
    box = vector.bounding_box(good, ["s_suppkey", "feature_id", "kind", "label"])
    return box.unionByName(f.where("issue is not null").select("s_suppkey", "issue"), allowMissingColumns=True)


@query(sql("SELECT k, ring, seq, round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2 FROM ze"))
def polygon_edge_table(spark, sf):
    return rounded(fx.zone_edges(spark, sf).drop("part"))


def _arcgis_points(spark, sf):
    k = F.col("c_custkey")
    x = F.when(k % 10 == 3, '"n/a"').otherwise(S("c_acctbal"))
    g = F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit('{"x":'), x, F.lit(',"y":'), S("c_custkey"), F.lit("}")))
    text = F.concat(F.lit('{"attributes":{"objectid":'), S("c_custkey"), F.lit(',"seg":"'), F.col("c_mktsegment"), F.lit('"},"geometry":'), g, F.lit("}"))
    return fx.table(spark, sf, "customer").select("c_custkey", text.alias("text"))


@query("""SELECT c_custkey, c_mktsegment AS seg, 'Point' AS kind, CASE WHEN c_custkey % 7 = 0 THEN 'null geometry' WHEN c_custkey % 10 = 3 THEN 'bad coordinate' END AS issue,
    CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 10 <> 3 THEN c_acctbal END AS x FROM customer""")
def arcgis_point_features(spark, sf):
    p = feat.parse_arcgis(_arcgis_points(spark, sf), "text", ["c_custkey"], "esriGeometryPoint")
    return p.select("c_custkey", F.col("attributes")["seg"].alias("seg"), "kind", "issue", F.col("x"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN '{"type":"LineString","coordinates":[[0.0,1.0],['||CAST(c_custkey AS VARCHAR)||'.0,2.0]]}'
    ELSE '{"type":"MultiLineString","coordinates":[[[0.0,1.0],['||CAST(c_custkey AS VARCHAR)||'.0,2.0]],[[5.0,5.0],[6.0,7.0]]]}' END AS geometry,
    CASE WHEN c_custkey % 7 = 0 THEN 'null geometry' WHEN c_custkey % 11 = 5 THEN 'short path' END AS issue FROM customer""")
def arcgis_to_geojson(spark, sf):
    k = F.col("c_custkey")
    one = F.concat(F.lit("[[0,1],["), S("c_custkey"), F.lit(",2]]"))
    paths = F.when(k % 11 == 5, F.lit("[[[1,1]]]")).when(k % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit(",[[5,5],[6,7]]]")))
    g = F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit('{"paths":'), paths, F.lit("}")))
    docs = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit('{"attributes":{"objectid":1},"geometry":'), g, F.lit("}")).alias("text"))
    p = feat.parse_arcgis(docs, "text", ["c_custkey"], "esriGeometryPolyline")
    return p.select("c_custkey", feat.esri_to_geojson(p).alias("geometry"), "issue")


@query("""SELECT l_orderkey, name, title FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'layer_'||CAST(l_linenumber // 3 AS VARCHAR) AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'Title '||CAST(l_linenumber AS VARCHAR) ELSE 'layer_'||CAST(l_linenumber // 3 AS VARCHAR) END AS title FROM lineitem)""")
def wms_capability_layers(spark, sf):
    """One capability document per order: a nameless root layer and a layer per line number; up to three share a name."""
    name = F.concat(F.lit("layer_"), F.floor(F.col("l_linenumber") / 3).cast("string"))
    title = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("<Title>Title "), S("l_linenumber"), F.lit("</Title>"))).otherwise("")
    layer = F.concat(F.lit("<Layer><Name> "), name, F.lit(" </Name>"), title, F.lit("</Layer>"))
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    # An order has at most seven line numbers.
    docs = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list(layer), "").alias("t"))
    text = F.concat(F.lit("<WMS_Capabilities><Capability><Layer><Title>Root</Title>"), "t", F.lit("</Layer></Capability></WMS_Capabilities>"))
    return feat.wms_layers(docs.select("l_orderkey", text.alias("text")), "text", ["l_orderkey"])


@query("""SELECT p_partkey, path, CAST(score AS INT) AS score FROM (SELECT p_partkey, 'data/'||p_brand||'/'||p_name||'.json' AS path,
    (CASE WHEN strpos(lower(p_name),'small')>0 THEN 20 ELSE 0 END)+(CASE WHEN strpos(lower(p_name),'ring')>0 THEN 10 ELSE 0 END)+(CASE WHEN strpos(lower(p_name),'large')>0 THEN 8 ELSE 0 END)+(CASE WHEN strpos(lower(p_name),'bolt')>0 THEN 4 ELSE 0 END) AS score FROM part)""")
def candidate_source_ranking(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("data/"), "p_brand", F.lit("/"), "p_name", F.lit(".json")).alias("path"))
    return tables.rank_candidates(p, "path", [("small", 20), ("ring", 10), ("large", 8), ("bolt", 4)])


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""")
def ragged_union(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return tables.union_ragged(c, p)


def _rings(spark, sf):
    """Per customer: a square with a hole, an island inside the hole, and a square apart; sizes vary."""
    k = F.col("c_custkey").cast("double")
    a = F.col("c_nationkey") / 10.0

    def square(x, y, r):
        return F.array(*[F.array(x + dx * r, y + dy * r) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])

    rings = F.array(square(k, k, 1.0 + a), square(k, k, 10.0 + a), square(k, k, 4.0 + a), square(k + 40.0, k, 2.0 + a))
    return fx.table(spark, sf, "customer").select("c_custkey", rings.alias("rings"))


@query("""SELECT c_custkey, ring_id, depth, parent, role FROM customer, (VALUES (0,2::BIGINT,2,'shell'),(1,0::BIGINT,NULL,'shell'),(2,1::BIGINT,1,'hole'),(3,0::BIGINT,NULL,'shell')) r(ring_id,depth,parent,role)""")
def ring_nesting(spark, sf):
    return topology.nest_rings(_rings(spark, sf), "c_custkey", 16.0).select("c_custkey", "ring_id", "depth", "parent", "role")


@query("""SELECT c_custkey, 3::BIGINT AS shells, 1::BIGINT AS holes, round(4e0*(pow(1e0+a,2)+pow(1e1+a,2)-pow(4e0+a,2)+pow(2e0+a,2)),6) AS area FROM (SELECT c_custkey, c_nationkey/1e1 AS a FROM customer)""")
def nested_polygon_area(spark, sf):
    return rounded(topology.nested_area(topology.nest_rings(_rings(spark, sf), "c_custkey", 16.0), "c_custkey"))


@query("""SELECT c_custkey, issue FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'self-crossing' WHEN 2 THEN 'unclosed ring' WHEN 3 THEN 'fewer than 4 points' WHEN 4 THEN 'bad coordinate' WHEN 5 THEN 'null geometry' END AS issue FROM customer) WHERE issue IS NOT NULL""")
def geometry_validity(spark, sf):
    k = F.col("c_custkey")
    x = k.cast("double")

    def ring(*pts):
        return F.array(F.array(*[F.array(x + dx, F.lit(float(dy))) for dx, dy in pts]))

    bad = F.array(F.array(*[F.array(x + dx, F.lit(float("nan")) if dy == 9 else F.lit(float(dy))) for dx, dy in ((0, 0), (2, 9), (2, 2), (0, 0))]))
    rings = (
        F.when(k % 6 == 0, ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))
        .when(k % 6 == 1, ring((0, 0), (2, 2), (0, 2), (2, 0), (0, 0)))
        .when(k % 6 == 2, ring((0, 0), (2, 0), (2, 2), (0, 2)))
        .when(k % 6 == 3, ring((0, 0), (2, 0), (0, 0)))
        .when(k % 6 == 4, bad)
    )
    return topology.validity_report(fx.table(spark, sf, "customer").select("c_custkey", rings.alias("rings")), "c_custkey", 5.0)


# Two-segment lines of the customers over the zones.
LINES = {
    "cl": """SELECT c_custkey, 0 AS seq, c_acctbal/1e2 AS x1, (c_custkey % 131)/131e0*h AS y1, c_nationkey*4e0+13e-1 AS x2, ((c_custkey*7) % 137)/137e0*h AS y2 FROM customer, h UNION ALL
        SELECT c_custkey, 1, c_nationkey*4e0+13e-1, ((c_custkey*7) % 137)/137e0*h, c_acctbal/2e2+3e0, ((c_custkey*3) % 127)/127e0*h FROM customer, h""",
    # Convex rings, corners in one turning sense: a line stays inside while it is on the inner side of all edges.
    # Holes lie inside their outlines and are taken off.
    "hp": """SELECT c.c_custkey, e.k, e.ring, c.seq, c.x1, c.y1, c.x2, c.y2, (e.x2-e.x1)*(c.y1-e.y1)-(e.y2-e.y1)*(c.x1-e.x1) AS d1, (e.x2-e.x1)*(c.y2-e.y1)-(e.y2-e.y1)*(c.x2-e.x1) AS d2 FROM cl c JOIN ze e ON TRUE""",
    "iv": """SELECT c_custkey, k, ring, seq, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2, greatest(0e0, max(CASE WHEN d2>d1 THEN d1/(d1-d2) END)) AS t0, least(1e0, min(CASE WHEN d2<d1 THEN d1/(d1-d2) END)) AS t1,
        bool_or(d1<0 AND d2<0) AS outside FROM hp GROUP BY 1,2,3,4""",
    "inl": "SELECT c_custkey, k, sum(CASE ring WHEN 0 THEN 1e0 ELSE -1e0 END*(t1-t0)*sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) AS len FROM iv WHERE NOT outside AND t1-t0 > 1e-12 GROUP BY 1,2",
}


def _customer_lines(spark, sf):
    h = float(fx.grid(spark, sf).height)
    k, n, b = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    y = lambda m, d: ((k * m) % d) / float(d) * h
    pts = F.array(F.array(b / 100.0, y(1, 131)), F.array(n * 4.0 + 1.3, y(7, 137)), F.array(b / 200.0 + 3.0, y(3, 127)))
    return fx.table(spark, sf, "customer").select("c_custkey", F.array(F.array(pts)).alias("coords"))


def _clip_inputs(spark, sf):
    lines, z = _customer_lines(spark, sf), fx.zones(spark, sf)
    return (
        vector.bounding_box(lines, ["c_custkey"]), vector.edges(lines, ["c_custkey"]), vector.bounding_box(z, ["k"]), vector.edges(z, ["k"]),
        "c_custkey", "k", max(10.0, fx.grid(spark, sf).height / 5.0),
    )


@query(sql("SELECT c_custkey, k, round(len,5) AS length, k AS source_layer FROM inl WHERE len > 1e-5", **LINES))
def clip_lines_to_regions(spark, sf):
    pieces = topology.clip_lines(*_clip_inputs(spark, sf))
    out = vector.line_length(pieces, ["c_custkey", "k"]).where("length > 1e-5")
    return topology.tag_layer(rounded(out, 5), F.col("k"))


@query(sql("SELECT c_custkey, k FROM inl WHERE len > 1e-5", **LINES))
def features_to_region(spark, sf):
    pieces = topology.clip_lines(*_clip_inputs(spark, sf))
    return vector.line_length(pieces, ["c_custkey", "k"]).where("length > 1e-5").select("c_custkey", "k")


# --- snapshots ---


@query("SELECT c_custkey, c_name FROM customer WHERE upper(c_mktsegment)='BUILDING' AND upper(CAST(c_nationkey AS VARCHAR))='7'")
def attribute_filter(spark, sf):
    c = fx.table(spark, sf, "customer").withColumn("nation", S("c_nationkey"))
    out = snapshot.attribute_filter(c, {"segment": "c_mktsegment", "nation": "nation"}, {"segment": "building", "nation": "7"})
    return out.select("c_custkey", "c_name")


@query("""WITH cat AS (SELECT DISTINCT event_type AS name, CASE WHEN event_type < 'p' THEN 'group-a' END AS grp FROM events), c AS (SELECT name, grp, row_number() OVER (ORDER BY name) AS pos FROM cat),
    req AS (SELECT user_id, event_id AS pos, CASE WHEN user_id % 13 = 0 OR event_id % 501 = 0 THEN 'all' WHEN event_id % 7 = 0 THEN 'group-a' ELSE event_type END AS name FROM events),
    mixed AS (SELECT user_id FROM req GROUP BY 1 HAVING bool_or(name='all') AND bool_or(name<>'all')),
    o AS (SELECT user_id, req.name AS member, 0 AS a, pos AS b FROM req WHERE req.name IN (SELECT name FROM c) UNION ALL SELECT user_id, c.name, 1, c.pos FROM req JOIN c ON c.grp=req.name UNION ALL SELECT user_id, c.name, 1, c.pos FROM req, c WHERE req.name='all'),
    f AS (SELECT user_id, member, min(a*1000000000000+b) AS k FROM o GROUP BY 1,2)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k, member) AS INT) AS position, member AS name, NULL AS problem FROM f WHERE user_id NOT IN (SELECT user_id FROM mixed)
    UNION ALL SELECT user_id, NULL, 'all', 'all beside other names' FROM mixed""")
def dataset_selection(spark, sf):
    e = fx.table(spark, sf, "events")
    kinds = e.select(F.col("event_type").alias("name")).distinct()
    # Numbered by counting smaller names: the kinds are a handful.
    from floodgrid.functions.ranking import global_rank

    cat = global_rank(kinds, [F.asc("name")], "pos").withColumn("grp", F.when(F.col("name") < "p", "group-a"))
    whole = (F.col("user_id") % 13 == 0) | (F.col("event_id") % 501 == 0)
    name = F.when(whole, "all").when(F.col("event_id") % 7 == 0, "group-a").otherwise(F.col("event_type"))
    req = e.select("user_id", F.col("event_id").alias("pos"), name.alias("name"))
    return snapshot.select_datasets(req, cat, "user_id")


PLAN = {
    "bt": "SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey)-1)//100 AS batch FROM orders",
    "recv": "SELECT l_orderkey AS id FROM lineitem UNION ALL SELECT -s_suppkey-1 FROM supplier",
    "cnt": "SELECT coalesce(p.id,r.id) AS id, p.id IS NOT NULL AS planned, coalesce(r.n,0) AS received FROM bt p FULL JOIN (SELECT id, count(*) AS n FROM recv GROUP BY 1) r ON p.id=r.id",
}


def _planned(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


def _received(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return li.unionByName(fx.table(spark, sf, "supplier").select((-F.col("s_suppkey") - 1).alias("id")))


@query(sql("SELECT batch, count(*) AS ids, sha256('['||string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id)||']') AS content_key FROM bt GROUP BY 1", **PLAN))
def id_batches(spark, sf):
    return snapshot.batch_keys(snapshot.id_batches(_planned(spark, sf), "id", 100), "id")


@query(sql("""SELECT id, 'missing' AS problem, received FROM cnt WHERE planned AND received=0 UNION ALL SELECT id, 'duplicate', received FROM cnt WHERE received>1 UNION ALL SELECT id, 'unexpected', received FROM cnt WHERE NOT planned""", **PLAN))
def batch_completeness(spark, sf):
    return snapshot.batch_problems(_planned(spark, sf), _received(spark, sf), "id")


@query(sql("""SELECT batch, count(*) AS ids, count(n) AS present, CASE WHEN count(n)=0 THEN 'absent' ELSE 'corrupt' END AS state FROM bt LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) r ON r.id=bt.id
    GROUP BY 1 HAVING count(*) FILTER (n=1) < count(*)""", **PLAN))
def resume_plan(spark, sf):
    got = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return snapshot.resume_plan(snapshot.id_batches(_planned(spark, sf), "id", 100), got, "id")


@query(sql("""SELECT (SELECT count(*) FROM orders) AS before_count, (SELECT count(*) FROM recv) AS after_count, count(*) FILTER (planned AND received=0) AS only_before, count(*) FILTER (NOT planned) AS only_after, (SELECT count(*) FROM orders)=(SELECT count(*) FROM recv) AND count(*) FILTER (planned AND received=0)=0 AND count(*) FILTER (NOT planned)=0 AS unchanged FROM cnt""", **PLAN))
def snapshot_drift(spark, sf):
    return snapshot.snapshot_drift(_planned(spark, sf), _received(spark, sf), "id")


STATUS = {"st": """SELECT o_orderpriority AS dataset, count(*) AS planned, CAST(sum(CASE WHEN o_orderpriority='5-LOW' AND r.id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS received FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem) r ON r.id=o_orderkey GROUP BY 1"""}


@query(sql("""SELECT dataset, planned, received, CASE WHEN planned=received THEN 'complete' ELSE 'failed' END AS status FROM st UNION ALL SELECT NULL, CAST(sum(planned) AS BIGINT), CAST(sum(received) AS BIGINT), CASE WHEN bool_and(planned=received) THEN 'complete' ELSE 'incomplete' END FROM st""", **STATUS))
def status_index(spark, sf):
    r = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("got", F.lit(1))
    o = fx.table(spark, sf, "orders").join(r, "o_orderkey", "left")
    lost = (F.col("o_orderpriority") == "5-LOW") & F.col("got").isNull()
    entries = o.groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("planned"), F.sum(F.when(lost, 0).otherwise(1)).alias("received"))
    return snapshot.status_index(entries, "dataset")


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 254 THEN text ELSE left(text, CAST(list_max(list_filter(range(0,255), lambda k: strlen(left(text, CAST(k AS BIGINT))) <= 254)) AS BIGINT)) END AS cut, strlen(text) > 254 AS truncated FROM documents""")
def utf8_truncation(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", snapshot.truncate_utf8(F.col("text")).alias("cut"), (F.octet_length("text") > 254).alias("truncated"))


@query("""SELECT conv_id*1000+turn AS id, 'text' AS field, CAST(strlen(text) AS INT) AS bytes, CAST(strlen(left(text, CAST(list_max(list_filter(range(0,255), lambda k: strlen(left(text, CAST(k AS BIGINT))) <= 254)) AS BIGINT))) AS INT) AS kept_bytes FROM conversations WHERE strlen(text)>254""")
def truncation_report(spark, sf):
    c = fx.table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return snapshot.truncation_report(c, "id", "text")


@query("""SELECT 'F000' AS short, 'c_custkey' AS field, count(c_custkey) AS filled FROM customer UNION ALL SELECT 'F001','c_name',count(c_name) FROM customer UNION ALL SELECT 'F002','c_nationkey',count(c_nationkey) FROM customer
    UNION ALL SELECT 'F003','c_acctbal',count(c_acctbal) FROM customer UNION ALL SELECT 'F004','c_mktsegment',count(c_mktsegment) FROM customer""")
def field_renaming(spark, sf):
    short, lookup = snapshot.rename_fields(fx.table(spark, sf, "customer"))
    counts = short.select(*[F.col(c).isNotNull().cast("long").alias(c) for c in short.columns])
    sums = counts.agg(*[F.sum(c).alias(c) for c in counts.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("short"), F.col(c).alias("filled")) for c in counts.columns])
    return sums.select(F.inline(rows)).join(F.broadcast(lookup), "short").select("short", "field", "filled")


# --- map data ---


@query(sql("""SELECT row, col, round(greatest(0e0, least(1e0, (v-lo)/(hi-lo))),6) AS stretched FROM (SELECT row, col, ln(1e0+flow.acc) AS v FROM flow) f, (SELECT quantile_cont(ln(1e0+flow.acc),0.02) AS lo, quantile_cont(ln(1e0+flow.acc),0.98) AS hi FROM flow) q"""))
def percentile_stretch(spark, sf):
    a = fx.acc(spark, sf).withColumn("value", F.col("acc").cast("double"))
    return rounded(cartodata.stretch(a, log=True).select("row", "col", "stretched"))


@query(sql("SELECT count(value) AS values, round(quantile_cont(abs(value),0.98),6) AS limit_value FROM chg", **SAR))
def symmetric_limit(spark, sf):
    return rounded(cartodata.symmetric_limit(sar_changes(spark, sf)))


LAB = "SELECT c_custkey, trim(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment||CAST(c_custkey % 40 AS VARCHAR) ELSE lower(c_mktsegment)||CAST(c_custkey % 40 AS VARCHAR) END) AS name, c_acctbal AS x, c_custkey*1e0 AS y FROM customer"


def _labels(spark, sf):
    k = F.col("c_custkey")
    n = (k % 40).cast("string")
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 3 == 0, F.concat("c_mktsegment", n)).otherwise("  ").alias("title"), F.concat(F.lower("c_mktsegment"), n).alias("fallback"),
        F.col("c_acctbal").alias("x"), k.cast("double").alias("y"),
    )


@query(sql("""SELECT c_custkey, name, x, y FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY c_custkey) AS r FROM lab_ WHERE x BETWEEN 0 AND 5e3 AND y BETWEEN 1e1 AND 1e5) WHERE r=1 ORDER BY c_custkey LIMIT 30""", lab_=LAB))
def label_points(spark, sf):
    return cartodata.label_points(_labels(spark, sf), ["title", "fallback"], "c_custkey", (0.0, 10.0, 5000.0, 1e5), 30)


@query(sql("SELECT name, round(avg(x),6) AS x, round(avg(y),6) AS y, count(*) AS features FROM lab_ WHERE strpos(lower(name),'build')>0 OR strpos(lower(name),'auto')>0 GROUP BY 1", lab_=LAB))
def label_mean_positions(spark, sf):
    return rounded(cartodata.label_means(_labels(spark, sf), ["title", "fallback"], ["build", "auto"]))


@query(sql("""SELECT scenario, cls AS value, CASE cls WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high-late' END AS label, CASE cls WHEN 1 THEN '#00ff00' WHEN 2 THEN '#ffff00' ELSE '#ff0000' END AS colour, count(*) AS cells FROM hc GROUP BY 1,2,3,4"""))
def legend_join(spark, sf):
    rows = [(0, 1, "low", "#00ff00"), (1, 2, "medium", "#ffff00"), (2, 3, "high", "#aa0000"), (3, 3, "high-late", "#ff0000")]
    entries = spark.createDataFrame(rows, "pos int, value int, label string, colour string")
    cells = fx.hazard(spark, sf).groupBy("scenario", F.col("cls").alias("value")).agg(F.count("*").alias("cells"))
    return cartodata.legend_join(cells, entries)


@query("""SELECT CASE WHEN strpos(lower(p_name),'ring')>0 THEN 'ring' WHEN strpos(lower(p_name),'small')>0 THEN 'small' ELSE 'other' END AS focus, count(*) AS features FROM part GROUP BY 1""")
def focus_classification(spark, sf):
    return cartodata.focus_counts(fx.table(spark, sf, "part"), "p_name", ["ring", "small"])


@query(sql("""SELECT seg, round(a-p,6) AS xmin, round(b-p,6) AS ymin, round(c+p,6) AS xmax, round(d+p,6) AS ymax FROM (SELECT *, greatest(c-a,d-b)*5e-2 AS p FROM (SELECT c_mktsegment AS seg, min(least(x1,x2)) AS a, min(least(y1,y2)) AS b, max(greatest(x1,x2)) AS c, max(greatest(y1,y2)) AS d
    FROM cl JOIN customer ON customer.c_custkey=cl.c_custkey GROUP BY 1))""", **LINES))
def extent_with_margin(spark, sf):
    seg = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    boxes = vector.bounding_box(_customer_lines(spark, sf), ["c_custkey"]).join(seg, "c_custkey")
    return rounded(cartodata.extent_with_margin(boxes, 0.05, ["seg"]))


MAN = {"fl_": "SELECT regexp_replace(split_part(url,'?',1),'[#].*$','') AS stem, CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'pdf' END AS ext, CAST(strlen(html) AS INT) AS bytes FROM pages"}


@query(sql("""SELECT stem, max(bytes) FILTER (ext='png') AS image_bytes, max(bytes) FILTER (ext='pdf') AS document_bytes, CASE WHEN count(*) FILTER (ext='png')=0 THEN 'IMAGE_MISSING' WHEN count(*) FILTER (ext='pdf')=0 THEN 'DOCUMENT_MISSING' ELSE 'OK' END AS status FROM fl_ GROUP BY 1""", **MAN))
def artifact_manifest(spark, sf):
    return cartodata.artifact_manifest(_artifacts(spark, sf), "png", "pdf")


@query(sql("""SELECT count(i) AS images, count(d) AS documents, count(i)=count(*) AND count(d)=count(*) AS complete FROM
    (SELECT stem, max(bytes) FILTER (ext='png') AS i, max(bytes) FILTER (ext='pdf') AS d FROM fl_ GROUP BY 1)""", **MAN))
def artifact_manifest_totals(spark, sf):
    """Every stem is expected to have both kinds."""
    files = _artifacts(spark, sf)
    expected = files.select("stem").distinct().count()
    return cartodata.manifest_summary(cartodata.artifact_manifest(files, "png", "pdf"), expected)


def _artifacts(spark, sf):
    return fx.table(spark, sf, "pages").select(
        F.regexp_replace(F.substring_index("url", "?", 1), "[#].*$", "").alias("stem"), F.when(F.col("page_id") % 2 == 0, "png").otherwise("pdf").alias("ext"), F.octet_length("html").alias("bytes")
    )
