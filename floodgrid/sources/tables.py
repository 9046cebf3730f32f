"""File inventories, ragged tables, reports and raster tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, path: str, keywords: list[str], extensions: list[str]) -> DataFrame:
    """(path, size_mb) of files whose name has a keyword and an extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    hit = reduce(Column.__or__, [name.contains(k.lower()) for k in keywords])
    ext = reduce(Column.__or__, [name.endswith(e.lower()) for e in extensions])
    return files.where(hit & ext).select("path", F.round(F.col("length") / 1024 / 1024, 3).alias("size_mb")).orderBy(F.lower("path"))


def rank_candidates(paths: DataFrame, path: str, weights: list[tuple[str, int]]) -> DataFrame:
    """Candidate files by name score, shorter paths first among equals."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    score = reduce(Column.__add__, [F.when(name.contains(w), s).otherwise(0) for w, s in weights])
    return paths.withColumn("score", score).orderBy(F.desc("score"), F.length(path), F.lower(path))


def union_ragged(*tables: DataFrame) -> DataFrame:
    """All rows under the union of the columns, in order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_geojson_lines(df: DataFrame, path: str, geometry_json: str, properties: list[str]) -> None:
    """One GeoJSON feature per line; ``geometry_json`` holds the geometry as text."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    line = F.concat(
        F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry_json, F.lit("null")), F.lit("}")
    )
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


RASTER_BLOCK = 512


def write_raster(cells: DataFrame, path: str, value: str = "value", dtype: str = "double", block: int = RASTER_BLOCK) -> None:
    """Cells as parquet, one folder per tile row and sorted by tile, nodata left out.

    The tile row is the partition column and the tile column is clustered inside, so a window
    read prunes folders and row groups; no file is tied to a single task by a hot tile.
    """
    trow = F.floor(F.col("row") / block).cast("int")
    tcol = F.floor(F.col("col") / block).cast("int")
    out = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast(dtype).alias(value), trow.alias("trow"), tcol.alias("tcol"))
    out.repartition("trow", "tcol").sortWithinPartitions("trow", "tcol", "row", "col").write.mode("errorifexists").partitionBy("trow").parquet(path)


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, block: int = RASTER_BLOCK) -> DataFrame:
    """Cells of a raster, or of a window of it with folder and row-group pruning."""
    df = spark.read.parquet(path)
    if rows:
        df = df.where(F.col("trow").between(rows[0] // block, rows[1] // block) & F.col("row").between(*rows))
    if cols:
        df = df.where(F.col("tcol").between(cols[0] // block, cols[1] // block) & F.col("col").between(*cols))
    return df.drop("trow", "tcol")


def explode_tiles(tiles: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Tile rows (row0, col0, w, data) to valid cells."""
    c = tiles.select("row0", "col0", "w", F.posexplode("data").alias("k", "value"))
    return c.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != nodata)).select(
        (F.col("row0") + F.expr("k div w")).cast("int").alias("row"), (F.col("col0") + F.col("k") % F.col("w")).cast("int").alias("col"), "value"
    )


def pack_tiles(cells: DataFrame, grid, block: int = RASTER_BLOCK, nodata: float = -9999.0) -> DataFrame:
    """Cells to dense tile rows of at most block x block values; absent cells hold nodata."""
    trow = F.floor(F.col("row") / block).cast("int").alias("trow")
    tcol = F.floor(F.col("col") / block).cast("int").alias("tcol")
    g = cells.select(trow, tcol, "row", "col", "value").groupBy("trow", "tcol").agg(
        F.map_from_entries(
            F.collect_list(F.struct(((F.col("row") % block) * F.lit(block) + F.col("col") % block).alias("k"), F.col("value").alias("v")))
        ).alias("m")
    )
    h = F.least(F.lit(block), F.lit(grid.height) - F.col("trow") * block)
    w = F.least(F.lit(block), F.lit(grid.width) - F.col("tcol") * block)
    g = g.withColumn("h", h).withColumn("w", w)
    data = F.expr(f"transform(sequence(0, h * w - 1), i -> coalesce(try_element_at(m, cast((i div w) * {block} + i % w as int)), {nodata}d))")
    return g.select(
        "trow", "tcol", (F.col("trow") * block).alias("row0"), (F.col("tcol") * block).alias("col0"), "h", "w", data.alias("data")
    )
