"""GeoJSON, ArcGIS JSON and WMS capability documents as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from floodgrid.runtime import write_and_read as materialize

_GEOJSON_DEPTH = {
    "Point": "array<double>",
    "LineString": "array<array<double>>",
    "MultiPoint": "array<array<double>>",
    "Polygon": "array<array<array<double>>>",
    "MultiLineString": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


def _coords(kind: Column, geometry: Column) -> Column:
    """Coordinates of any kind as part, ring or path, vertex, (x, y)."""
    get = lambda k: F.try_variant_get(geometry, "$.coordinates", _GEOJSON_DEPTH[k])
    return (
        F.when(kind == "Point", F.array(F.array(F.array(get("Point")))))
        .when(kind == "LineString", F.array(F.array(get("LineString"))))
        .when(kind == "MultiPoint", F.array(F.array(get("MultiPoint"))))
        .when(kind == "Polygon", F.array(get("Polygon")))
        .when(kind == "MultiLineString", F.transform(get("MultiLineString"), lambda p: F.array(p)))
        .when(kind == "MultiPolygon", get("MultiPolygon"))
    )


def parse_features(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, feature_id, kind, properties, coords, issue) from collection or feature documents.

    Features without geometry are skipped. A geometry collection gives a row per member. A text that
    is not JSON, and a geometry that cannot be read, give a row with the issue.
    """
    # One pass: a text that is not JSON goes through as a single feature without anything in it.
    parsed = docs.select(*keys, F.try_parse_json(F.col(text)).alias("_v"))
    many = F.try_variant_get("_v", "$.features", "array<variant>")
    feats = F.coalesce(many, F.array("_v"))
    f = parsed.select(*keys, F.col("_v").isNull().alias("_broken"), F.posexplode(feats).alias("feature_id", "_f"))
    geometry = F.try_variant_get("_f", "$.geometry", "variant")
    members = F.coalesce(F.try_variant_get(geometry, "$.geometries", "array<variant>"), F.array(geometry))
    f = f.select(*keys, "_broken", "feature_id", F.try_variant_get("_f", "$.properties", "map<string,string>").alias("properties"), F.explode(members).alias("_g"))
    f = f.withColumn("kind", F.try_variant_get("_g", "$.type", "string")).where("_broken or kind is not null")
    f = f.withColumn("coords", _coords(F.col("kind"), F.col("_g"))).drop("_g")
    issue = F.when(F.col("_broken"), "broken document").when(F.col("coords").isNull(), "unreadable geometry")
    numbered = F.when(~F.col("_broken"), F.col("feature_id")).alias("feature_id")
    return f.select(*keys, numbered, "kind", "properties", "coords", issue.alias("issue"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections, one per file."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return parse_features(docs, "text", ["path"])


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line; files of any size are split between tasks."""
    docs = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return parse_features(docs, "text", ["path"]).drop("feature_id")


def _running(chunks: DataFrame, of: Callable[[Column], Column], values: list[str]) -> DataFrame:
    """``values`` replaced by their running sum or maximum along each file; null where nothing came yet.

    Blocks of a file run by themselves; what comes before a block follows from one row per block.
    """
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = chunks.groupBy("path", "block").agg(*[of(F.col(v)).alias(v) for v in values])
    before = whole.select("path", "block", *[of(F.col(v)).over(ahead).alias(f"_{v}") for v in values])
    both = chunks.withColumns({v: of(F.col(v)).over(inside) for v in values}).join(before, ["path", "block"])
    put = (lambda a, b: F.greatest(a, b)) if of is F.max else (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return both.withColumns({v: put(F.col(v), F.col(f"_{v}")) for v in values}).drop(*[f"_{v}" for v in values])


def read_large_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``read_geojson`` for files of any size: one collection is read by many tasks.

    Spark splits the files and cuts them behind every closing brace. Running counts of quotes, braces
    and brackets say where a piece stands in the document; pieces up to the brace that ends an element of
    the root's ``features`` are put together and parsed, so a task holds single features. Files without such an array
    (one feature, an empty collection) are parsed whole. Null elements have no number here. A file whose braces,
    brackets or quotes do not pair gives one row with the issue ``broken document``; in others a
    feature that is not JSON gives such a row in its place, beside the readable ones.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    order = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    chunks = materialize(raw.select(*order, "value"))
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("long")
    quoted = chunks.withColumn("clean", clean).withColumn("own", count(F.col("clean"), '"')).withColumn("quotes", F.col("own"))
    quoted = _running(quoted, F.sum, ["quotes"])
    # Text outside of strings; a piece that starts within a string gets the quote it lacks.
    opened = F.when((F.col("quotes") - F.col("own")) % 2 == 1, '"').otherwise("")
    quoted = quoted.withColumn("bare", F.regexp_replace(F.concat(opened, "clean"), '"[^"]*("|$)', "")).withColumn("out", F.col("quotes") % 2 == 0)
    braces = count(F.col("bare"), "{") - F.col("out").cast("long")
    brackets = count(F.col("bare"), "[") - count(F.col("bare"), "]")
    depth = quoted.withColumns({"db": braces, "dk": brackets}).withColumns({"braces": F.col("db"), "brackets": F.col("dk")})
    depth = _running(depth, F.sum, ["braces", "brackets"])
    was_brace, was_bracket = F.col("braces") - F.col("db"), F.col("brackets") - F.col("dk")
    # Pieces in which a new array of the root begins; the latest one says whether elements are features.
    begins = (was_brace <= 1) & (((was_bracket == 0) & (F.col("brackets") > 0)) | ((was_bracket == 1) & F.col("bare").rlike(r"^[^\[\]{}]*\]")))
    named = F.col("clean").rlike(r'"features"\s*:\s*\[')
    ends = F.col("out") & (F.col("braces") == 1) & (F.col("brackets") == 1)
    marked = depth.withColumns({"begins": begins, "since": F.when(begins, F.struct("block", "at", named.alias("named"))), "ends": ends})
    marked = _running(marked, F.max, ["since"]).withColumn("inside", F.coalesce("since.named", F.lit(False)))
    marked = marked.withColumn("ends", F.col("ends") & F.col("inside")).withColumn("n", F.col("ends").cast("long"))
    marked = _running(marked, F.sum, ["n"]).withColumn("n", F.col("n") - F.col("ends").cast("long"))
    lead = F.when(F.col("begins"), F.regexp_replace("value", r'(?s)^.*?"features"\s*:\s*\[[\s,]*', "")).otherwise(F.col("value"))
    pieces = materialize(marked.select("path", "block", "at", "n", "ends", "inside", F.struct("since.block", "since.at").alias("since"), "value", lead.alias("text"), "braces", "brackets", "out"))

    last = F.max_by(F.struct("braces", "brackets", "out", (F.trim(F.regexp_replace("value", r"\s", "")) == "").alias("blank")), F.struct("block", "at"))
    files = pieces.groupBy("path").agg(last.alias("l"), F.max("ends").alias("many"))
    paired = F.col("l.out") & (F.col("l.brackets") == 0) & ((F.col("l.braces") == 0) | ((F.col("l.braces") == -1) & F.col("l.blank")))
    extra = (F.col("l.braces") == -1).alias("extra")  # the file does not end with its last brace
    files = materialize(files.select("path", "many", paired.alias("paired"), extra))

    def put_together(of: DataFrame, keys: list[str], text: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("block", "at", F.concat(text, F.lit("}")).alias("t"))))
        return of.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.max("ends").alias("ended"))

    good = pieces.join(files.where("paired and many").select("path"), "path", "left_semi").where("inside")
    parts = put_together(good, ["path", "since", "n"], "text").where("ended")
    parts = parts.withColumn("text", F.regexp_replace("text", r"^(?:[\s,]|null\b)+", ""))
    single = pieces.join(files.where("paired and not many").select("path", "extra"), "path")
    single = put_together(single, ["path", "extra"], "value").withColumn("text", F.when(F.col("extra"), F.regexp_replace("text", r"\}$", "")).otherwise(F.col("text")))
    found = parse_features(parts, "text", ["path", "n"]).withColumn("feature_id", F.col("n").cast("int")).drop("n")
    broken = files.where("not paired").select("path", F.lit("broken document").alias("issue"))
    return found.unionByName(parse_features(single, "text", ["path"])).unionByName(broken, allowMissingColumns=True)


# --- ArcGIS JSON ---

ESRI_KINDS = {"esriGeometryPoint": "Point", "esriGeometryPolyline": "Line", "esriGeometryPolygon": "Polygon"}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def parse_arcgis(docs: DataFrame, text: str, keys: list[str], kind: str) -> DataFrame:
    """(keys, attributes, kind, rings or paths, x, y, issue) from feature documents.

    Points and lines with missing or non-finite coordinates carry the issue ``bad coordinate``,
    lines with fewer than two vertices ``short path``; a missing geometry is ``null geometry``.
    """
    v = F.try_parse_json(F.col(text))
    arr = "array<array<array<double>>>"
    g = docs.select(
        *keys,
        F.try_variant_get(v, "$.attributes", "map<string,string>").alias("attributes"),
        F.try_variant_get(v, "$.geometry", "variant").alias("_g"),
    ).select(
        *keys,
        "attributes",
        (F.col("_g").isNull() | F.is_variant_null("_g")).alias("_none"),
        F.try_variant_get("_g", "$.rings", arr).alias("rings"),
        F.try_variant_get("_g", "$.paths", arr).alias("paths"),
        F.try_variant_get("_g", "$.x", "double").alias("x"),
        F.try_variant_get("_g", "$.y", "double").alias("y"),
    )
    bad_vertex = F.exists(F.flatten("paths"), lambda p: (F.size(p) < 2) | ~_finite(F.get(p, F.lit(0))) | ~_finite(F.get(p, F.lit(1))))
    issue = F.when(F.col("_none"), "null geometry")
    if kind == "esriGeometryPoint":
        issue = issue.when(~(_finite(F.col("x")) & _finite(F.col("y"))), "bad coordinate")
    elif kind == "esriGeometryPolyline":
        short = F.col("paths").isNull() | (F.size("paths") == 0) | F.exists("paths", lambda p: F.size(p) < 2)
        issue = issue.when(short, "short path").when(bad_vertex, "bad coordinate")
    return g.withColumn("kind", F.lit(ESRI_KINDS[kind])).withColumn("issue", issue).drop("_none")


def esri_to_geojson(features: DataFrame) -> Column:
    """GeoJSON geometry text: one path gives LineString, one ring Polygon, several the Multi kinds.

    Polygons are taken with ``parts`` (shells with their holes) when the column is there.
    """
    has_parts = "parts" in features.columns
    poly = F.col("parts") if has_parts else F.array(F.col("rings"))
    t = lambda name, c: F.to_json(F.struct(F.lit(name).alias("type"), c.alias("coordinates")))
    return (
        F.when(F.col("issue").isNotNull(), None)
        .when(F.col("kind") == "Point", t("Point", F.array("x", "y")))
        .when((F.col("kind") == "Line") & (F.size("paths") == 1), t("LineString", F.col("paths")[0]))
        .when(F.col("kind") == "Line", t("MultiLineString", F.col("paths")))
        .when(F.size(poly) == 1, t("Polygon", poly[0]))
        .otherwise(t("MultiPolygon", poly))
    )


# --- WMS capabilities ---


_BLANK = " \t\r\n"


def _local(element: ElementTree.Element) -> str:
    """Name of an element without its namespace."""
    return element.tag.rpartition("}")[2]


def _last_text(layer: ElementTree.Element, kind: str) -> str | None:
    """Text of the last child of that name that is not blank."""
    texts = [e.text for e in layer if _local(e) == kind and e.text and e.text.strip(_BLANK)]
    return texts[-1].strip(" ") if texts else None


def _named_layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the named layers of the documents in the last column, which are parsed once each."""
    for batch in batches:
        at, names, titles = [], [], []
        for i, doc in enumerate(batch.column(batch.num_columns - 1)):
            text = doc.as_py()
            for layer in ElementTree.fromstring(text).iter() if text else ():
                name = _last_text(layer, "Name") if _local(layer) == "Layer" else None
                if name is not None:
                    at.append(i)
                    names.append(name)
                    titles.append(_last_text(layer, "Title") or name)
        keys = [c.take(pa.array(at, "int64")) for c in batch.columns[:-1]]
        fields = [*batch.schema.names[:-1], "name", "title"]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(names, "string"), pa.array(titles, "string")], names=fields)


def wms_layers(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, name, title) of the named layers of capability documents; a title defaults to the name."""
    source = docs.select(*keys, text)
    schema = StructType([*source.schema.fields[:-1], StructField("name", StringType()), StructField("title", StringType())])
    return source.mapInArrow(_named_layers, schema)


def read_wms_layers(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return wms_layers(docs, "text", ["path"])
