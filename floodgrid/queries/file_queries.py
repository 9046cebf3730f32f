"""Files written below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floodgrid.queries import fixtures as fx
from floodgrid.queries.registry import query
from floodgrid.queries.sqlparts import sql
from floodgrid.runtime import shared_dir
from floodgrid.sources import features, tables


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT DISTINCT c_mktsegment AS segment, TRUE AS found FROM customer")
def file_inventory(spark, sf):
    """Text files, one folder per market segment; folders of other names and marker files do not count."""
    path = _folder(spark)
    names = fx.table(spark, sf, "customer").select(F.col("c_name").alias("value"), F.col("c_mktsegment").alias("segment"))
    names.write.partitionBy("segment").text(path)
    files = tables.file_inventory(spark, path, ["part-"], [".txt"])
    segment = F.regexp_extract("path", "segment=([^/]+)/", 1)
    return files.groupBy(segment.alias("segment")).agg((F.min("size_mb") >= 0).alias("found"))


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def report_round_trip(spark, sf):
    """One JSON object per line with nulls written out."""
    path = _folder(spark)
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    rows = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", segment.alias("segment"))
    tables.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Point' AS kind, s_suppkey*1e0 AS x, s_nationkey*1e0 AS y FROM supplier")
def geojson_round_trip(spark, sf):
    """Points written as one feature per line."""
    path = _folder(spark)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")).alias("coordinates")))
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), point.alias("g"))
    tables.write_geojson_lines(rows, path, "g", ["id"])
    back = features.read_geojson_lines(spark, path)
    at = F.col("coords")[0][0][0]
    return back.select(F.col("properties")["id"].alias("id"), "kind", at[0].alias("x"), at[1].alias("y"))


@query("""SELECT CAST(o_orderkey // 10000 AS BIGINT) AS document, CAST(row_number() OVER (PARTITION BY o_orderkey // 10000 ORDER BY o_orderkey) - 1 AS INT) AS feature_id,
    CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || '}' AS priority, CAST(o_orderkey % 100 AS DOUBLE) AS x, CAST(o_orderkey // 100 AS DOUBLE) AS y FROM orders""")
def geojson_collection_pieces(spark, sf):
    """Orders as feature collections, one per 10,000 keys, written as one document a file and read in pieces."""
    path = _folder(spark)
    k = F.col("o_orderkey")
    point = F.struct(F.lit("Point").alias("type"), F.array((k % 100).cast("double"), F.floor(k / 100).cast("double")).alias("coordinates"))
    properties = F.struct(k.alias("id"), F.concat("o_orderpriority", F.lit("}")).alias("priority"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), point.alias("geometry")))
    rows = fx.table(spark, sf, "orders").select(F.floor(k / 10000).alias("document"), F.struct(k.alias("k"), feature.alias("f")).alias("e"))
    ordered = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["f"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}"))
    rows.groupBy("document").agg(text.alias("value")).write.partitionBy("document").text(path)
    back = features.read_large_geojson(spark, path)
    at, has = F.col("coords")[0][0][0], F.col("properties")
    document = F.regexp_extract("path", "document=([0-9]+)/", 1).cast("long")
    return back.select(document.alias("document"), "feature_id", has["id"].alias("id"), has["priority"].alias("priority"), at[0].alias("x"), at[1].alias("y"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part")
def csv_round_trip(spark, sf):
    """Rows of two tables with different columns in one CSV folder."""
    path = _folder(spark)
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    rows = tables.union_ragged(c, p)
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(sql("SELECT row, col, z AS value FROM g"))
def raster_round_trip(spark, sf):
    path = _folder(spark)
    tables.write_raster(fx.dem(spark, sf), path, block=64)
    return tables.read_raster(spark, path)


@query(sql("SELECT row, col, z AS value FROM g WHERE row BETWEEN 20 AND 90 AND col BETWEEN 30 AND 70"))
def raster_window_read(spark, sf):
    """A window of a written raster; other folders and row groups are pruned."""
    path = _folder(spark)
    tables.write_raster(fx.dem(spark, sf), path, block=64)
    return tables.read_raster(spark, path, (20, 90), (30, 70), block=64)


@query(sql("SELECT row, col, z AS value FROM g"))
def tile_pack_round_trip(spark, sf):
    """Cells packed to dense tiles and unpacked."""
    return tables.explode_tiles(tables.pack_tiles(fx.dem(spark, sf), fx.grid(spark, sf), block=32))
