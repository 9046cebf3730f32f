"""Feature snapshots: filters, batches, completeness, drift, status and export shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.functions.ranking import global_rank


def attribute_filter(df: DataFrame, supported: dict[str, str], wanted: dict[str, str | None], everything: bool = False) -> DataFrame:
    """Exact case-insensitive filters joined by AND.

    ``supported`` maps option names to columns. An option the dataset lacks, filters together
    with ``everything``, or neither of the two, is refused before any data is read.
    """
    given = {k: v for k, v in wanted.items() if v}
    for k in given:
        if k not in supported:
            raise ValueError(f"dataset has no filter {k!r}")
    if everything and given:
        raise ValueError("filters cannot be combined with everything")
    if not everything and not given:
        raise ValueError("give at least one filter, or ask for everything")
    out = df
    for k, v in given.items():
        out = out.where(F.upper(F.col(supported[k])) == v.upper())
    return out


def select_datasets(requests: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, position, name, problem): datasets asked for, groups expanded, each once, order kept.

    ``requests`` has (key, pos, name), ``catalog`` (name, grp, pos). Single names keep their
    order; members of groups follow in catalog order; ``all`` stands for the whole catalog
    and must be alone: beside other names the request is refused, as one row with the problem.
    """
    asks = requests.groupBy(key).agg(F.bool_or(F.col("name") == "all").alias("_all"), F.bool_or(F.col("name") != "all").alias("_other"))
    refused = asks.where("_all and _other").select(key)
    requests = requests.join(refused, key, "left_anti")
    c = catalog.select(F.col("name").alias("member"), "grp", F.col("pos").alias("_cpos"))
    single = requests.join(c, F.col("name") == F.col("member")).select(key, F.lit(0).alias("_k"), F.col("pos").alias("_p"), F.col("member"))
    group = requests.join(c, (F.col("name") == F.col("grp"))).select(key, F.lit(1).alias("_k"), F.col("_cpos").alias("_p"), "member")
    # The catalog is the list of dataset kinds, short enough for one value.
    whole = c.agg(F.collect_list(F.struct(F.lit(1).alias("_k"), F.col("_cpos").alias("_p"), "member"))).scalar()
    every = requests.where("name = 'all'").select(key).distinct().withColumn("_c", whole).select(key, F.inline("_c"))
    first = single.unionByName(group).unionByName(every).groupBy(key, "member").agg(F.min(F.struct("_k", "_p")).alias("_o"))
    # One row per dataset kind and request, a short list.
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_o", "member"))
    chosen = first.select(key, pos.alias("position"), F.col("member").alias("name"), F.lit(None).cast("string").alias("problem"))
    return chosen.unionByName(
        refused.select(key, F.lit(None).cast("int").alias("position"), F.lit("all").alias("name"), F.lit("all beside other names").alias("problem"))
    )


def id_batches(ids: DataFrame, column: str, size: int) -> DataFrame:
    """(id, batch): ordered ids cut into batches of ``size``."""
    ranked = global_rank(ids.select(column).distinct(), [F.asc(column)], "_r")
    return ranked.select(column, F.floor((F.col("_r") - 1) / size).cast("long").alias("batch"))


def batch_keys(batches: DataFrame, column: str) -> DataFrame:
    """Content key of each batch: sha256 of its ids written as a JSON list.

    A batch has a fixed size, so its list is short.
    """
    ids = F.array_sort(F.collect_list(column))
    text = F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: i.cast("string")), ", "), F.lit("]"))
    return batches.groupBy("batch").agg(F.count("*").alias("ids"), F.sha2(text, 256).alias("content_key"))


def received_counts(planned: DataFrame, received: DataFrame, column: str) -> DataFrame:
    """(id, planned, received) counts from one grouping of both lists."""
    a = planned.select(column, F.lit(1).alias("p"), F.lit(0).alias("r"))
    b = received.select(column, F.lit(0).alias("p"), F.lit(1).alias("r"))
    return a.unionByName(b).groupBy(column).agg(F.max("p").alias("planned"), F.sum("r").alias("received"))


def batch_problems(planned: DataFrame, received: DataFrame, column: str) -> DataFrame:
    """Missing, duplicate and unexpected ids."""
    c = received_counts(planned, received, column)
    kinds = F.array_compact(
        F.array(
            F.when((F.col("planned") == 1) & (F.col("received") == 0), "missing"),
            F.when(F.col("received") > 1, "duplicate"),
            F.when(F.col("planned") == 0, "unexpected"),
        )
    )
    return c.select(column, F.explode(kinds).alias("problem"), "received")


def resume_plan(batches: DataFrame, received: DataFrame, column: str) -> DataFrame:
    """Batches to fetch again: none of the ids there (absent), or not exactly one of each (corrupt)."""
    got = received.groupBy(column).agg(F.count("*").alias("n"))
    b = batches.join(got, column, "left").groupBy("batch").agg(
        F.count("*").alias("ids"), F.count("n").alias("present"), F.count_if(F.col("n") == 1).alias("exact")
    )
    state = F.when(F.col("present") == 0, "absent").otherwise("corrupt")
    return b.where("exact < ids").select("batch", "ids", "present", state.alias("state"))


def snapshot_drift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Did the id list change: counts, ids on one side only, verdict."""
    a = before.select(column, F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = after.select(column, F.lit(0).alias("a"), F.lit(1).alias("b"))
    c = a.unionByName(b).groupBy(column).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = c.agg(
        F.sum("a").alias("before_count"),
        F.sum("b").alias("after_count"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_before"),
        F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("only_after"),
    )
    same = (F.col("only_before") == 0) & (F.col("only_after") == 0) & (F.col("before_count") == F.col("after_count"))
    return out.withColumn("unchanged", same)


def status_index(entries: DataFrame, dataset: str, count_only: bool = False) -> DataFrame:
    """Status per dataset and one overall row (NULL dataset); ``entries`` has planned, received."""
    good = "counted" if count_only else "complete"
    ok = (F.col("planned") == F.col("received")) if not count_only else F.col("planned").isNotNull()
    per = entries.groupBy(dataset).agg(F.sum("planned").alias("planned"), F.sum("received").alias("received"), F.every(ok).alias("_ok"))
    status = lambda fail: F.when(F.col("_ok"), good).otherwise(fail)
    rows = per.select(dataset, "planned", "received", status("failed").alias("status"))
    total = per.agg(F.sum("planned").alias("planned"), F.sum("received").alias("received"), F.every("_ok").alias("_ok"))
    kind = entries.schema[dataset].dataType
    return rows.unionByName(
        total.select(F.lit(None).cast(kind).alias(dataset), "planned", "received", status("incomplete").alias("status"))
    )


def _continues(data: Column, at: int) -> Column:
    """Is the byte at a 1-based position a UTF-8 continuation byte."""
    b = F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int")
    return b.between(128, 191)


def truncate_utf8(text: Column, limit: int = 254) -> Column:
    """Longest prefix of whole characters within ``limit`` bytes (the width of a text field)."""
    data = F.encode(text, "UTF-8")
    cut = lambda n: F.decode(F.substring(data, 1, n), "UTF-8")
    out = F.when(F.octet_length(text) <= limit, text)
    for n in range(limit, limit - 3, -1):
        out = out.when(~_continues(data, n + 1), cut(n))
    return out.otherwise(cut(limit - 3))


def truncation_report(df: DataFrame, key: str, field: str, limit: int = 254) -> DataFrame:
    t = F.coalesce(F.col(field).cast("string"), F.lit(""))
    return df.where(F.octet_length(t) > limit).select(
        key, F.lit(field).alias("field"), F.octet_length(t).alias("bytes"), F.octet_length(truncate_utf8(t, limit)).alias("kept_bytes")
    )


def short_names(fields: list[str]) -> dict[str, str]:
    """Fixed-width export names F000, F001, ... for the columns in order."""
    return {f"F{i:03d}": f for i, f in enumerate(fields)}


def rename_fields(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns under short names, and the lookup (short, field) back."""
    names = short_names(df.columns)
    lookup = df.sparkSession.createDataFrame(list(names.items()), "short string, field string")
    return df.toDF(*names), lookup
