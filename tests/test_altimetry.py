"""Limits that must not exist: depth of documents, rows that decide roles, broken texts."""

from floodgrid.functions.graph import components
from floodgrid.functions.skew import join_hot
from floodgrid.operators import altimetry


def test_nodes_of_deep_documents(spark):
    deep = "[" * 40 + "1" + "]" * 40
    docs = spark.createDataFrame([(1, deep), (2, "{broken"), (3, None)], "k int, text string")
    nodes = altimetry.json_nodes(docs, "text", ["k"])
    assert nodes.where("k = 1").count() == 41
    assert {r.kind for r in nodes.where("k > 1").collect()} == {"broken"}


def test_all_rows_decide_roles(spark):
    rows = [("t", [-0.5, 100.0, 50.0]) if i < 500 else ("t", [100.0, -0.5, 50.0]) for i in range(3000)]
    found = altimetry.column_roles(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v").collect()
    assert [(r.lat_index, r.lon_index, r.height_index) for r in found] == [(1, 0, 2)]
    assert abs(found[0].lat_score - 2500 / 3000) < 1e-12


def test_beam_of_a_path(spark):
    df = spark.createDataFrame([("$.GT1L.x[0]",), ("$.gt1l.gt3R",), ("$.a",)], "p string")
    assert [r[0] for r in df.select(altimetry.beam_of(df["p"])).collect()] == ["gt1l", "gt3r", "UNKNOWN"]


def test_components_with_keys(spark):
    edges = [("x", i, i + 1) for i in range(30)] + [("y", i, i + 2) for i in range(10)]
    got = {(r.k, r.node): r.label for r in components(spark.createDataFrame(edges, "k string, a bigint, b bigint"), ["k"]).collect()}
    assert got == {**{("x", i): 0 for i in range(31)}, **{("y", i): i % 2 for i in range(12)}}


def test_join_with_two_keys_and_a_hot_one(spark):
    rows = spark.range(900).selectExpr("id", "'a' AS g", "CASE WHEN id % 2 = 0 THEN 5 ELSE id END AS k")
    values = spark.range(400).selectExpr("'a' AS g", "id AS k", "id * 2 AS v")
    got = {tuple(r) for r in join_hot(rows, values, ["g", "k"], how="left").select("id", "v").collect()}
    assert got == {tuple(r) for r in rows.join(values, ["g", "k"], "left").select("id", "v").collect()}
