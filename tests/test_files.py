"""Readers, writers, feature documents and snapshot rules."""

import json

import pytest
from pyspark.sql import functions as F

from floodgrid.operators import snapshot, topology
from floodgrid.operators.catalog import parse_time
from floodgrid.operators.grid import Grid, assert_aligned, from_rows, overview_factors
from floodgrid.plans.flood_index import normalise
from floodgrid.runtime import shared_dir
from floodgrid.sources import features, tables

POLY = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}


def test_geojson_file_and_lines(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"n": "a", "k": 3}, "geometry": POLY},
            {"type": "Feature", "properties": {"n": "b"}, "geometry": None},
            {"type": "Feature", "properties": {"n": "c"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 1], [1, 1]], [[5, 5], [6, 6]]]}},
        ],
    }
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    got = features.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("feature_id").collect()
    assert [(r.kind, r.properties["n"]) for r in got] == [("Polygon", "a"), ("MultiLineString", "c")]
    assert got[0].coords == [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]]
    assert got[1].coords == [[[[0.0, 1.0], [1.0, 1.0]]], [[[5.0, 5.0], [6.0, 6.0]]]]
    out = spark.createDataFrame([(1, "x", json.dumps(POLY)), (2, "y", None)], "id int, n string, g string")
    tables.write_geojson_lines(out, str(tmp_path / "lines"), "g", ["id", "n"])
    back = features.read_geojson_lines(spark, str(tmp_path / "lines")).collect()
    assert [(r.kind, r.properties["id"]) for r in back] == [("Polygon", "1")]


def test_large_collections_are_read_in_pieces_as_whole(spark, tmp_path):
    odd = ["}{", '"features":[{', "\\\\", '\\"}', "]", "", "null", "a,b"]
    feats = []
    for i in range(400):
        kind = [{"type": "Point", "coordinates": [i, 0.5]}, POLY, {"type": "GeometryCollection", "geometries": [POLY, {"type": "Point", "coordinates": [1, i]}]}, None][i % 4]
        feats.append({"type": "Feature", "properties": {"n": odd[i % 8], "k": i, "deep": {"features": [{"x": {}}]}}, "geometry": kind})
    body = {"meta": {"features": [{"type": "Point"}], "s": "}"}, "others": [{"a": {}}, {"b": 1}], "features": feats, "after": [{"type": "Feature", "geometry": POLY}], "z": {}}
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "compact.geojson").write_text(json.dumps({"type": "FeatureCollection", **body}))
    (folder / "indented.geojson").write_text(json.dumps(body, indent=3) + "\n")
    (folder / "no_tail.geojson").write_text('{"features":[' + ",\n".join(json.dumps(f) for f in feats[:9]) + "]}")
    (folder / "single.geojson").write_text(json.dumps(feats[1]) + " \n")
    (folder / "single_tight.geojson").write_text(json.dumps({"type": "Feature", "geometry": POLY, "properties": {"n": "t", "k": {}}}))
    (folder / "none.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (folder / "cut.geojson").write_text(json.dumps({"features": feats})[:5000])
    (folder / "text.geojson").write_text("no json")
    key = lambda r: (r.path.rsplit("/", 1)[1], r.feature_id, r.kind, json.dumps(r.properties), json.dumps(r.coords), r.issue)
    want = sorted(map(key, features.read_geojson(spark, str(folder)).collect()), key=str)
    for size in ("700", "5000", "64m"):
        small = spark.newSession()
        small.conf.set("spark.sql.files.maxPartitionBytes", size)
        small.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(map(key, features.read_large_geojson(small, str(folder)).collect()), key=str)
        assert got == want


def test_wms_layers(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<w:C xmlns:w="http://w"><w:Layer><w:Title>Root</w:Title><w:Layer><w:Name>a</w:Name><w:Title>A</w:Title></w:Layer>'
        "<w:Layer><w:Name> b </w:Name><w:Style><w:Name>s</w:Name><w:Title>S</w:Title></w:Style></w:Layer></w:Layer></w:C>"
    )
    got = features.read_wms_layers(spark, str(tmp_path / "c.xml")).select("name", "title").collect()
    assert sorted(map(tuple, got)) == [("a", "A"), ("b", "b")]


def test_wms_documents_are_parsed_once(spark):
    """Names and titles stay with their layer, whatever stands in the others; blank and null documents have none."""
    layers = (
        "<Layer><Title>T0</Title><Layer><Name>n1</Name></Layer><Layer><Name> </Name><Title>T2</Title></Layer>"
        "<Layer><Name>n&amp;3</Name><Title/><Layer><Name><![CDATA[n4]]></Name><Title> T4 </Title></Layer></Layer>"
        "<Layer><Name><!-- x -->n5</Name><Title>a</Title><Title>b</Title></Layer></Layer>"
    )
    docs = spark.createDataFrame([(1, f"<C>{layers}</C>"), (2, ""), (3, None), (4, "<C/>")], "k int, text string")
    out = features.wms_layers(docs, "text", ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "n&3", "n&3"), (1, "n1", "n1"), (1, "n4", "T4"), (1, "n5", "b")]
    assert "xpath" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_inventory_reads_no_content(spark, tmp_path):
    for name, size in (("GFI_x.tif", 3), ("other.tif", 1), ("gfi.txt", 2)):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / name).write_bytes(b"0" * size * 1024 * 1024)
    got = tables.file_inventory(spark, str(tmp_path / "in"), ["gfi"], [".tif"]).collect()
    assert [(r.path.rsplit("/", 1)[1], r.size_mb) for r in got] == [("GFI_x.tif", 3.0)]


def test_ragged_csv_and_report(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 5.0)], "id int, b double")
    tables.write_csv(tables.union_ragged(a, b), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", "x", None), ("2", None, "5.0")]
    tables.write_report(a, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value == '{"id":1,"a":"x"}'


def test_raster_table_window_and_tiles(spark, tmp_path):
    g = Grid(11, 9)
    cells = from_rows(spark, g).withColumn("value", (F.col("row") * 11 + F.col("col")).cast("double"))
    cells = cells.where("row != 4 or col != 4")
    path = str(tmp_path / "r")
    tables.write_raster(cells, path, block=4)
    window = tables.read_raster(spark, path, rows=(3, 5), cols=(2, 5), block=4)
    assert {(r.row, r.col) for r in window.collect()} == {(r, c) for r in (3, 4, 5) for c in (2, 3, 4, 5)} - {(4, 4)}
    assert "PartitionFilters: [isnotnull(trow" in window._jdf.queryExecution().toString()
    tiles = tables.pack_tiles(cells, g, block=4)
    assert tiles.count() == 9
    back = tables.explode_tiles(tiles)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_nested_rings_area_97(spark):
    sq = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    rings = [sq(0.0, 0.0, 10.0), sq(4.0, 4.0, 2.0), sq(20.0, 0.0, 1.0)]
    df = spark.createDataFrame([(1, rings)], "id int, rings array<array<array<double>>>")
    nesting = topology.nest_rings(df, "id", 5.0)
    assert tuple(topology.nested_area(nesting, "id").first()) == (1, 2, 1, 97.0)
    parts = topology.grouped_parts(nesting, topology.ring_table(df, "id"), "id").first().parts
    assert [len(p) for p in parts] == [2, 1]


def test_validity_keeps_two_issues(spark):
    bow = [[[0.0, 0.0], [2.0, 2.0], [0.0, 2.0], [2.0, 0.0], [0.0, 0.0]]]
    df = spark.createDataFrame([(1, bow), (2, None)], "id int, rings array<array<array<double>>>")
    assert sorted(map(tuple, topology.validity_report(df, "id", 1.0).collect())) == [(1, "self-crossing"), (2, "null geometry")]


def test_filter_rules(spark):
    df = spark.createDataFrame([(1, "O'Neil"), (2, "x")], "id int, company string")
    spec = {"company": "company"}
    assert snapshot.attribute_filter(df, spec, {"company": "o'neil"}).first().id == 1
    assert snapshot.attribute_filter(df, spec, {}, everything=True).count() == 2
    for wanted, everything in (({"province": "a"}, False), ({"company": "a"}, True), ({}, False)):
        with pytest.raises(ValueError):
            snapshot.attribute_filter(df, spec, wanted, everything)


@pytest.mark.parametrize("text", ["a" * 300, "é" * 200, "a" + "é" * 200, "漢" * 100, "ab" + "😀" * 90, "short", ""])
def test_truncation_never_splits_a_character(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(snapshot.truncate_utf8(F.col("t"))).first()[0]
    assert got == text.encode()[:254].decode("utf-8", "ignore")


def test_resume_and_drift(spark):
    ids = spark.range(1, 8).withColumnRenamed("id", "k")
    batches = snapshot.id_batches(ids, "k", 3)
    got = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (5,), (6,)], "k long")
    plan = {r.batch: r.state for r in snapshot.resume_plan(batches, got, "k").collect()}
    assert plan == {1: "corrupt", 2: "absent"}
    assert snapshot.snapshot_drift(ids, ids, "k").first().unchanged
    assert not snapshot.snapshot_drift(ids, got, "k").first().unchanged


def test_status_overall(spark):
    rows = [("a", 3, 3), ("b", 2, 1)]
    got = {r.d: r.status for r in snapshot.status_index(spark.createDataFrame(rows, "d string, planned long, received long"), "d").collect()}
    assert got == {"a": "complete", "b": "failed", None: "incomplete"}


def test_alignment_and_degenerate_range(spark):
    meta = "crs string, width int, height int, res_x double, res_y double, origin_x double, origin_y double"
    row = ("EPSG:32747", 5, 4, 1.0, -1.0, 0.0, 0.0)
    assert_aligned(spark.createDataFrame([row, row], meta))
    with pytest.raises(ValueError, match="width"):
        assert_aligned(spark.createDataFrame([row, ("EPSG:32747", 6, *row[2:])], meta))
    with pytest.raises(Exception, match="degenerate"):
        normalise(spark.createDataFrame([(1.0,), (1.0,)], "gfi double")).collect()


def test_lenient_times(spark):
    rows = [("2025-11-25T03:04:05Z",), ("2025-11-25T03:04:05",), ("not a time",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.unix_seconds(parse_time(F.col("t")))).collect()]
    assert got == [1764039845, 1764039845, None, None, None]


def test_overview_factors():
    assert overview_factors(2048, 1100) == [2, 4]
    assert overview_factors(300, 300) == []


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_feature_documents_are_read_and_parsed_once(spark):
    rows = [(1, json.dumps({"type": "Feature", "properties": {"n": "a"}, "geometry": POLY})), (2, "{"), (3, None), (4, "null")]
    docs = spark.createDataFrame(rows, "d int, text string")
    out = features.parse_features(docs, "text", ["d"])
    got = {r["d"]: (r["feature_id"], r["kind"], r["properties"], r["issue"]) for r in out.collect()}
    broken = (None, None, None, "broken document")
    assert got == {1: (0, "Polygon", {"n": "a"}, None), 2: broken, 3: broken}
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
