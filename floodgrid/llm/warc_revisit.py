"""Not-modified revisits resolved against the latest earlier full response of the same URL.

Records (revisits and responses) meet by canonical URL in time order. They are cut into ranges by
(URL, time), so a URL with a third of all captures is spread over many tasks; within a range a window
finds the latest response, and the last response of each URL in each range is carried to the next
ranges. Bodies stay out of it: a resolved revisit names its response.

A revisit is ``resolved`` if its validators agree with the response's: the entity tags where it has
one (weak and strong tags of equal value agree), else the modification dates. Otherwise it is
``changed`` (validators differ), ``unvalidated`` (nothing to compare) or ``no_response``. A resolved
revisit's headers are the response's, with those of the revisit in place except the ones that a
not-modified answer may not renew: connection and body headers.

Cases: null URLs have no canonical form and match nothing; records without a date come before dated
ones and are never earlier than another; a response at the same time as the revisit is not earlier;
of responses at one time the greatest record id counts; repeated records stay; null or repeated
headers are kept in order, names without regard to case; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.runtime import write_and_read as materialize

# Headers of a connection or of a body, which stay as they were stored.
NOT_RENEWED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade",
]
# Query parameters that name a visitor's way, not a page.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, path without last slash, sorted query without tracking."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, "(.)/+$", "$1"))
    parts = F.split(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", whole).otherwise(F.trim(F.regexp_replace(url, "#.*$", "")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header; null without it."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with permitted fresh ones in place of those of the same name."""
    stored, fresh = F.coalesce(stored, F.array()), F.coalesce(fresh, F.array())
    renewed = F.filter(fresh, lambda h: h["name"].isNotNull() & ~F.lower(h["name"]).isin(NOT_RENEWED))
    names = F.transform(renewed, lambda h: F.lower(h["name"]))
    stays = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False)))
    return F.concat(stays, renewed)


def _tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, date, kind, status, headers).

    ``kind`` is ``response`` or ``revisit``; only responses of status 200 are full; ``headers`` is an
    array of (name, value); ``date`` is any ordered type. Other columns are not needed and ignored.
    """
    slim = records.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200))).select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical_url"),
        "date",
        (F.col("kind") == "revisit").alias("revisit"),
        "headers",
    )
    # At one time revisits come before responses, so that none resolves to a response of its own time.
    order = [F.col("date").asc_nulls_first(), F.col("revisit").desc(), F.col("record_id").asc_nulls_first()]
    keyed = slim.where("canonical_url IS NOT NULL")
    cut = keyed.repartitionByRange(F.col("canonical_url"), *order).withColumn("range", F.spark_partition_id())
    cut = materialize(cut)
    full = F.when(
        ~F.col("revisit") & F.col("date").isNotNull(),
        F.struct(F.col("record_id").alias("response_id"), F.col("date").alias("response_date"), F.col("headers").alias("response_headers")),
    )
    # A range is what one task can hold, so its rows of one URL are too.
    inside = Window.partitionBy("range", "canonical_url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("revisit").drop("revisit")
    # One row per URL and range, at most as many per URL as there are ranges.
    place = F.struct(F.col("date"), F.col("record_id"))
    ends = cut.where("NOT revisit AND date IS NOT NULL").groupBy("canonical_url", "range").agg(F.max_by(full, place).alias("end"))
    marks = ends.unionByName(
        seen.where("near IS NULL").select("canonical_url", "range").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    )
    merged = marks.groupBy("canonical_url", "range").agg(F.first("end", ignorenulls=True).alias("end"))
    before = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = merged.withColumn("far", F.last("end", ignorenulls=True).over(before)).where("far IS NOT NULL")
    found = seen.where("near IS NOT NULL").unionByName(
        seen.where("near IS NULL").drop("near").join(carried.select("canonical_url", "range", F.col("far").alias("near")), ["canonical_url", "range"], "left")
    )
    lost = slim.where("canonical_url IS NULL AND revisit").drop("revisit")
    found = found.drop("range").unionByName(lost.withColumn("near", F.lit(None).cast(found.schema["near"].dataType)))
    undated = F.col("date").isNull()
    return _checked(found.withColumn("near", F.when(~undated, F.col("near"))))


def _checked(found: DataFrame) -> DataFrame:
    old, new = F.col("near")["response_headers"], F.col("headers")
    tag, old_tag = _tag(header(new, "etag")), _tag(header(old, "etag"))
    when, old_when = header(new, "last-modified"), header(old, "last-modified")
    by_tag = tag.isNotNull() & old_tag.isNotNull()
    by_date = tag.isNull() & when.isNotNull() & old_when.isNotNull()
    outcome = (
        F.when(F.col("near").isNull(), "no_response")
        .when(by_tag, F.when(tag == old_tag, "resolved").otherwise("changed"))
        .when(by_date, F.when(when == old_when, "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    judged = found.withColumn("outcome", outcome)
    return judged.select(
        "record_id",
        "canonical_url",
        "date",
        "outcome",
        F.col("near")["response_id"].alias("response_id"),
        F.when(F.col("outcome") == "resolved", merged_headers(old, new)).otherwise(new).alias("headers"),
    )
