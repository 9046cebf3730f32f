"""Tables that grow with the input are never sent through the driver for a join."""

import pytest
from pyspark.sql import functions as F

from floodgrid.functions.quantiles import group_percentiles
from floodgrid.queries import QUERIES
from floodgrid.queries import fixtures as fx
from floodgrid.runtime import materialize

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_written_tables_go_by_shuffle(spark):
    cells = spark.range(10_000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    a, b = materialize(cells), materialize(cells.where("col < 50"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "BroadcastExchange" not in plan(a.join(b.groupBy("row", "col").agg(F.count("*").alias("n")), ["row", "col"], how))
    names = spark.range(2).select(F.col("id").cast("int").alias("row"))
    assert "BroadcastHashJoin" in plan(a.join(F.broadcast(names), "row"))


@pytest.mark.parametrize("name", ["ring_nesting", "nested_polygon_area", "flow_exits", "snap_to_local_maximum"])
def test_queries_broadcast_no_table_that_grows(spark, name):
    assert "BroadcastExchange" not in plan(QUERIES[name](spark, SF))


def test_zone_cells_meet_the_names_by_broadcast(spark):
    text = plan(fx.named_zone_cells(spark, SF))
    assert "SortMergeJoin" not in text.split("BroadcastExchange")[0] and "BroadcastHashJoin" in text


@pytest.mark.parametrize("few", [0, 10_000])
def test_percentiles_do_not_depend_on_the_way_of_the_join(spark, monkeypatch, few):
    from floodgrid.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    df = spark.range(1_001).select((F.col("id") % 3 == 0).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id")).cast("double").alias("v"))
    got = {r["g"]: (r["a"], r["b"]) for r in group_percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    want = df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()
    assert got == {r["g"]: (pytest.approx(r["a"]), pytest.approx(r["b"])) for r in want}


def test_tasks_read_small_pieces_of_shuffled_cells(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(key)
    try:
        fx.table(spark, SF, "orders")
        assert spark.conf.get(key) == "4m"
        spark.conf.set(key, "1m")
        fx.table(spark, SF, "orders")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_broadcasts_that_no_hint_asks_for_are_small(spark):
    planned, at_run_time = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for key in (planned, at_run_time):
        spark.conf.unset(key)
    try:
        fx.table(spark, SF, "orders")
        assert spark.conf.get(planned) == "1m" and spark.conf.get(at_run_time, None) is None
        spark.conf.set(planned, "-1")
        spark.conf.set(at_run_time, "20m")
        fx.table(spark, SF, "orders")
        assert spark.conf.get(planned) == "-1" and spark.conf.get(at_run_time) == "1m"
    finally:
        for key in (planned, at_run_time):
            spark.conf.unset(key)


def test_chains_of_the_overlay_are_not_broadcast(spark):
    from floodgrid.operators import polygon_overlay, topology

    assert polygon_overlay.materialize is materialize and topology.materialize is materialize


def test_channels_below_seeds_are_computed_once(spark):
    from floodgrid.queries.hazard_queries import _channel_sets

    # Slopes are windows over all cells.
    assert "Window" not in plan(_channel_sets(spark, SF)["slope_area"])
