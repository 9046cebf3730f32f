"""Data behind maps: stretches, limits, labels, legends, extents, artifact lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.quantiles import group_percentiles


def stretch(cells: DataFrame, value: str = "value", log: bool = False, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values scaled to 0..1 between two percentiles and clamped; log1p first for accumulation."""
    v = F.log1p(F.when(F.col(value) >= 0, F.col(value))) if log else F.col(value)
    src = cells.withColumn("_v", v)
    q = group_percentiles(src, [], "_v", {"lo": low, "hi": high})
    out = src.withColumn("_lo", q.select("lo").scalar()).withColumn("_hi", q.select("hi").scalar())
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return out.withColumn("stretched", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_v", "_lo", "_hi")


def symmetric_limit(layers: DataFrame, value: str = "value", prob: float = 0.98) -> DataFrame:
    """One limit for several layers: percentile of the absolute values; 1 without any value."""
    q = group_percentiles(layers.withColumn("_a", F.abs(value)), [], "_a", {"limit_value": prob})
    one = layers.agg(F.count(value).alias("values"))
    return one.withColumn("limit_value", F.coalesce(q.scalar(), F.lit(1.0)))


def first_attribute(names: list[str]) -> Column:
    """First non-blank candidate column as trimmed text."""
    return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names])


def label_points(features: DataFrame, candidates: list[str], order: str, extent: tuple[float, float, float, float], limit: int = 30) -> DataFrame:
    """First label per lower-case name inside the extent (xmin, ymin, xmax, ymax), at most ``limit``.

    ``limit`` is the number of labels a map shows; features come in the order of ``order``.
    """
    named = features.withColumn("name", first_attribute(candidates)).where("name is not null")
    inside = named.where(F.col("x").between(extent[0], extent[2]) & F.col("y").between(extent[1], extent[3]))
    first = inside.groupBy(F.lower("name").alias("_key")).agg(
        F.min(order).alias(order), F.min_by(F.struct("name", "x", "y"), F.col(order)).alias("_f")
    )
    return first.orderBy(order).limit(limit).select(order, "_f.*")


def label_means(features: DataFrame, candidates: list[str], words: list[str]) -> DataFrame:
    """Mean position of the features whose name contains one of the words, per name."""
    named = features.withColumn("name", first_attribute(candidates))
    low = F.lower("name")
    match = F.lit(False)
    for w in words:
        match = match | low.contains(w.lower())
    return named.where(match).groupBy("name").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("features"))


def legend_join(cells: DataFrame, entries: DataFrame, value: str = "value") -> DataFrame:
    """Label and colour per value; among duplicate entries the last one (by ``pos``) counts."""
    last = entries.groupBy("value").agg(F.max_by(F.struct("label", "colour"), "pos").alias("_e")).select("value", "_e.*")
    return cells.join(last.withColumnRenamed("value", value), value, "left")


def focus_class(name: Column, words: list[str]) -> Column:
    """The first word contained in the name, 'other' without one."""
    c = F.lit("other")
    for w in reversed(words):
        c = F.when(F.lower(name).contains(w.lower()), w.lower()).otherwise(c)
    return c


def focus_counts(features: DataFrame, name: str, words: list[str]) -> DataFrame:
    return features.groupBy(focus_class(F.col(name), words).alias("focus")).agg(F.count("*").alias("features"))


def extent_with_margin(boxes: DataFrame, margin: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Union of boxes grown by a share of the longer side."""
    g = boxes.groupBy(*keys) if keys else boxes
    e = g.agg(F.min("xmin").alias("a"), F.min("ymin").alias("b"), F.max("xmax").alias("c"), F.max("ymax").alias("d"))
    p = F.greatest(F.col("c") - F.col("a"), F.col("d") - F.col("b")) * margin
    return e.select(
        *(keys or []), (F.col("a") - p).alias("xmin"), (F.col("b") - p).alias("ymin"), (F.col("c") + p).alias("xmax"), (F.col("d") + p).alias("ymax")
    )


def artifact_manifest(files: DataFrame, image: str, document: str) -> DataFrame:
    """(stem, image, document, status) from a file list with (stem, ext, bytes)."""
    of = lambda e, c: F.max(F.when(F.col("ext") == e, F.col(c)))
    g = files.groupBy("stem").agg(
        of(image, "bytes").alias("image_bytes"), of(document, "bytes").alias("document_bytes")
    )
    status = F.when(F.col("image_bytes").isNull(), "IMAGE_MISSING").when(F.col("document_bytes").isNull(), "DOCUMENT_MISSING").otherwise("OK")
    return g.withColumn("status", status)


def manifest_summary(manifest: DataFrame, expected: int) -> DataFrame:
    out = manifest.agg(F.count("image_bytes").alias("images"), F.count("document_bytes").alias("documents"))
    return out.withColumn("complete", (F.col("images") == expected) & (F.col("documents") == expected))


