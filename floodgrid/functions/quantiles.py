"""Exact grouped percentiles that never hold one group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgrid.runtime import by_shuffle
from floodgrid.runtime import write_and_read as materialize

# Rows that are joined by broadcast.
FEW = 10_000
# Equal parts of a group's range of values, for up to so many groups that are narrowed.
BUCKETS = 256
NARROWED_GROUPS = 500


def group_percentiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], limits: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated percentiles per group: one row per group, one column per name.

    The builtin exact ``percentile`` keeps every distinct value of a group in one buffer. Here values
    are counted per (group, value) with map-side combine and cut into ranges by (group, value). Sums
    per group and range tell which ranges hold a wanted rank; only those are ordered, each range of a
    group in its own window, so no task holds more than a range, whatever the size of a group.

    ``limits`` (keys, _lo, _hi: the extremes per group, a written table) narrows the values first, unless
    there are very many groups: counts per equal part of a group's range tell which parts hold a wanted rank, and only
    their values are shuffled. ``df`` is then read twice more, so it should come from a written table.
    """
    v = F.col(value) if isinstance(value, str) else value
    if not keys:
        one = df.withColumn("_all", F.lit(0))
        return group_percentiles(one, ["_all"], value, probs, limits).drop("_all")
    pos, slots = _rank_slots(probs, F.col("_total"))
    inside = F.filter(slots, lambda s: (s["rank"] >= F.col("_before")) & (s["rank"] < F.col("_upto")))
    group = Window.partitionBy(*keys)
    values = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    narrow = limits is not None and limits.count() <= NARROWED_GROUPS
    if narrow:
        values = _in_parts(values, keys, limits)
        sums = group.orderBy("_bucket")
        parts = values.groupBy(*keys, "_bucket").agg(F.count("*").alias("_bn")).withColumn("_upto", F.sum("_bn").over(sums)).withColumn("_total", F.sum("_bn").over(group))
        parts = parts.withColumn("_before", F.col("_upto") - F.col("_bn"))
        # A few rows per group: the parts that hold a wanted rank, and how many values lie in other parts below.
        parts = parts.where(F.size(inside) > 0).withColumn("_skip", F.col("_upto") - F.sum("_bn").over(sums))
        parts = materialize(parts.select(*keys, "_bucket", "_skip", "_total"))
        values = _same_keys(values, F.broadcast(parts.select(*keys, "_bucket")), [*keys, "_bucket"])
    hist = values.groupBy(*keys, *(["_bucket"] if narrow else []), "_v").agg(F.count("*").alias("_n"))
    cut = materialize(hist.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    # One row per range that holds some of the group.
    upto = F.sum("_pn").over(group.orderBy("_part"))
    if narrow:
        sizes = cut.groupBy(*keys, "_part", "_bucket").agg(F.sum("_n").alias("_pn"))
        upto = F.sum("_pn").over(group.orderBy("_bucket", "_part"))
        sizes = _same_keys(sizes.withColumn("_upto", upto), F.broadcast(parts), [*keys, "_bucket"]).withColumn("_upto", F.col("_upto") + F.col("_skip"))
        sizes = sizes.select(*keys, "_bucket", "_part", (F.col("_upto") - F.col("_pn")).alias("_before"), "_upto", "_total")
        # A range and a part of the values together are what one window orders.
        keys, final = [*keys, "_bucket"], keys
    else:
        final = keys
        sizes = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_pn"))
        sizes = sizes.select(*keys, "_part", (upto - F.col("_pn")).alias("_before"), upto.alias("_upto"), F.sum("_pn").over(group).alias("_total"))
    wanted = sizes.withColumn("_want", inside).where(F.size("_want") > 0)
    wanted = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_total", "_want")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    # One row per range with a wanted rank: a list, unless there are very many groups.
    wanted = materialize(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else by_shuffle(wanted)
    rows = cut.join(wanted, (F.col("_part") == F.col("_p")) & same)
    ordered = Window.partitionBy("_part", *keys).orderBy("_v")
    ranked = rows.withColumn("_end", F.sum("_n").over(ordered) + F.col("_before")).withColumn("_start", F.col("_end") - F.col("_n"))
    own = F.filter("_want", lambda s: (s["rank"] < F.col("_end")) & (s["rank"] >= F.col("_start")))
    hit = ranked.select(*final, "_v", "_total", F.inline(own))
    picked = hit.groupBy(*final, "_total").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("_v"))).alias(f"_s{s}") for s in range(2 * len(probs))]
    )
    return picked.select(*final, *_interpolated(probs, pos))


def _same_keys(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a list by ``keys``, of which any may be NULL."""
    others = [c for c in few.columns if c not in keys]
    named = few.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *others)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])


def _in_parts(values: DataFrame, keys: list[str], limits: DataFrame) -> DataFrame:
    """``values`` with ``_bucket``, which never falls as the value rises; one part where the range has no finite width."""
    span = F.col("_hi") - F.col("_lo")
    usable = (span > 0) & ~F.isnan(span) & (span < float("inf"))
    share = (F.col("_v") - F.col("_lo")) / F.when(usable, span)
    bucket = F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int")
    return _same_keys(values, F.broadcast(limits.select(*keys, "_lo", "_hi")), keys).select(*keys, "_v", bucket.alias("_bucket"))


def _rank_slots(probs: dict[str, float], total: Column) -> tuple[list[Column], Column]:
    """Fractional positions, and an array of the (slot, rank) pairs around each of them."""
    pos = [F.lit(p) * (total - 1) for p in probs.values()]
    slots = F.array(
        *[
            F.struct(F.lit(2 * i + k).alias("slot"), rank.cast("long").alias("rank"))
            for i, p in enumerate(pos)
            for k, rank in enumerate((F.floor(p), F.ceil(p)))
        ]
    )
    return pos, slots


def _interpolated(probs: dict[str, float], pos: list[Column]) -> list[Column]:
    out = []
    for i, name in enumerate(probs):
        lo, hi = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        out.append((lo + (hi - lo) * (pos[i] - F.floor(pos[i]))).alias(name))
    return out


def group_stats(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], plain: dict[str, Column], narrow: bool = False
) -> DataFrame:
    """``plain`` aggregates and exact percentiles side by side, one row per group; ``narrow`` as ``limits`` in
    ``group_percentiles``."""
    if not keys:
        one = df.withColumn("_all", F.lit(0))
        return group_stats(one, ["_all"], value, probs, plain, narrow).drop("_all")
    aggs = df.groupBy(*keys)
    if not narrow:
        return aggs.agg(*[c.alias(n) for n, c in plain.items()]).join(group_percentiles(df, keys, value, probs), keys, "left")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    aggs = materialize(aggs.agg(*[c.alias(n) for n, c in plain.items()], F.min(v).alias("_lo"), F.max(v).alias("_hi")))
    return aggs.drop("_lo", "_hi").join(group_percentiles(df, keys, value, probs, aggs.select(*keys, "_lo", "_hi")), keys, "left")
