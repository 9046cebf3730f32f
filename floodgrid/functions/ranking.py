"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.runtime import materialize


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 1-based positions in a total order.

    Rows are cut into ordered ranges, numbered inside each range, and shifted by the sizes of
    the ranges before; only the range sizes (one row per partition) meet in one window.
    """
    cut = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(ahead, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per range, at most the shuffle partition count.
    return (
        cut.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + inside).cast("long"))
        .drop("_part", "_start")
    )
