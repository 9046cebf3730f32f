"""Scene and granule catalogs: periods, triplets, repeat tracks, coverage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.ranking import global_rank
from floodgrid.runtime import materialize


@dataclass(frozen=True)
class Windows:
    """Closed period bounds as UTC timestamp texts; what lies between them is OTHER."""

    pre: tuple[str, str]
    event: tuple[str, str]
    post: tuple[str, str]


def parse_time(text: Column) -> Column:
    """Lenient ISO time in UTC; anything else becomes NULL."""
    return F.try_to_timestamp(F.trim(text))


def _micros(c: str | Column) -> Column:
    """Microseconds of a time with or without zone, in the session's (UTC) zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def period(ts: Column, w: Windows) -> Column:
    def within(b: tuple[str, str]) -> Column:
        return ts.between(F.lit(b[0]).cast("timestamp"), F.lit(b[1]).cast("timestamp"))

    return (
        F.when(ts.isNull(), "UNKNOWN").when(within(w.pre), "PRE").when(within(w.event), "EVENT").when(within(w.post), "POST").otherwise("OTHER")
    )


def first_filled(props: Column, *names: str) -> Column:
    """First non-blank value among alternative property names of a map; '' when there is none."""
    vals = [F.nullif(props[n], F.lit("")) for n in names]
    return F.coalesce(*vals, F.lit(""))


def normalise_scenes(raw: DataFrame, props: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    keep = [c for c in raw.columns if c != props]
    return raw.select(*keep, *[first_filled(F.col(props), *names).alias(n) for n, names in fields.items()])


FEATURE = "struct<type:string,properties:map<string,string>>"
PAYLOAD = "struct<type:string,features:array<struct<type:string,properties:map<string,string>>>,properties:map<string,string>>"


def flatten_collections(payloads: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Features of payloads that are one collection, or a list of collections and features."""
    is_list = F.ltrim(F.col(text)).startswith("[")
    items = F.when(is_list, F.from_json(text, f"array<{PAYLOAD}>")).otherwise(F.array(F.from_json(text, PAYLOAD)))
    item = payloads.select(*keys, is_list.alias("_list"), F.posexplode(items).alias("item", "_i"))
    single = F.array(F.struct(F.col("_i.type").alias("type"), F.col("_i.properties").alias("properties")))
    feats = F.when(F.col("_i.type") == "FeatureCollection", F.col("_i.features")).when(
        F.col("_list") & (F.col("_i.type") == "Feature"), single
    )
    return item.select(*keys, "item", F.posexplode(feats).alias("seq", "_f")).select(
        *keys, "item", "seq", F.col("_f.properties").alias("properties")
    )


# Fixed value: granule names carry track (4 digits), cycle (2) and region (2) after the timestamp.
GRANULE = r"ATL(?:03|08)_\d{14}_(\d{4})(\d{2})(\d{2})_"


def parse_granule(name: Column) -> tuple[Column, Column, Column]:
    part = lambda i: F.regexp_extract(name, GRANULE, i)
    return part(1), part(2), part(3)


# Microseconds in a thousandth of a day, the unit that days between granules are rounded to.
MILLIDAY = 86_400_000


def repeat_pairs(granules: DataFrame, sums: bool = False) -> DataFrame:
    """Every PRE granule with every POST granule of the same track and region.

    The pairs are the result here; the join key (track, region) is checked per pair, and rows
    without track or region never enter. With ``sums`` the same pairs are counted and their days summed per track,
    region and pair of cycles (``pairs``, ``total_days``), without a row for a pair.
    """
    g = granules.where("track != '' and region != ''")
    if sums:
        return _pair_sums(g)
    side = lambda p: g.where(F.col("period") == p.upper()).select(
        "track", "region", F.col("granule").alias(f"{p}_granule"), F.col("cycle").alias(f"{p}_cycle"), F.col("begin").alias(f"{p}_begin")
    )
    days = (_micros("post_begin") - _micros("pre_begin")) / 86400e6
    return side("pre").join(side("post"), ["track", "region"]).withColumn("delta_days", F.round(days, 3))


def _pair_sums(g: DataFrame) -> DataFrame:
    """Count and summed ``delta_days`` of ``repeat_pairs`` per track, region and pair of cycles.

    In thousandths of a day, with a PRE time set back by half of one, a pair's rounded days are the difference of the
    whole parts q, less one where the POST granule's rest r is the smaller one. At equal rests, where the exact value ends
    in a half, days below zero round away from it: there the whole parts decide. So only the pairs with POST (r, q) up to
    PRE (r, q) need to be counted, which takes an order and running counts. Granules are cut into ranges of (r, q);
    a task orders one range of a track and region, and whole ranges meet by their counts.
    """
    line = ["track", "region"]
    post = F.col("period") == "POST"
    at = _micros("begin") - F.when(post, 0).otherwise(MILLIDAY // 2)
    rest = F.pmod(at, F.lit(MILLIDAY))
    placed = g.where(F.col("period").isin("PRE", "POST")).select(*line, post.alias("post"), "cycle", rest.alias("r"), ((at - rest) / MILLIDAY).cast("long").alias("q"))
    counted = placed.groupBy(*placed.columns).agg(F.count("*").alias("n"))
    cut = materialize(counted.repartitionByRange(*line, "r", "q").withColumn("_part", F.spark_partition_id()))
    timed = F.when(F.col("q").isNotNull(), F.col("n"))

    def sides(*keys: str, **aggs: Column) -> tuple[DataFrame, DataFrame]:
        """Sums per key and cycle, of the PRE and of the POST granules."""
        s = cut.groupBy(*line, *keys, "post", "cycle").agg(*[c.alias(n) for n, c in aggs.items()])
        named = lambda df, p: df.select(*line, *[F.col(c).alias(p + c) for c in ("cycle", *keys, *aggs)])
        return named(s.where("NOT post"), "pre_"), named(s.where("post"), "post_")

    pair = [*line, "pre_cycle", "post_cycle"]
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    pre, post = sides(n=F.sum("n"), timed=F.coalesce(F.sum(timed), F.lit(0)), q=F.coalesce(F.sum(timed * F.col("q")), F.lit(0)))
    whole = exact("pre_timed") * exact("post_q") - exact("post_timed") * exact("pre_q")
    every = pre.join(post, line).select(*pair, (F.col("pre_n") * F.col("post_n")).alias("pairs"), (F.col("pre_timed") * F.col("post_timed")).alias("timed"), whole.cast("decimal(38,0)").alias("total"))
    # POST granules of earlier ranges, and those within the range of the PRE granule.
    pre, post = sides("_part", n=F.coalesce(F.sum(timed), F.lit(0)))
    earlier = pre.join(post, line).where("post__part < pre__part").select(*pair, (F.col("pre_n") * F.col("post_n")).alias("less"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in every.select(*pair).schema] + ["less long"])
    within = cut.where("q IS NOT NULL").groupBy(*line, "_part").applyInPandas(_posts_up_to_pres, schema)
    less = earlier.unionByName(within).select(*pair, F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("timed"), (-F.col("less")).cast("decimal(38,0)").alias("total"))
    out = every.unionByName(less).groupBy(*pair).agg(F.sum("pairs").alias("pairs"), F.sum("timed").alias("_timed"), F.sum("total").alias("_total"))
    return out.select(*pair, "pairs", F.when(F.col("_timed") > 0, F.col("_total").cast("double") / 1000.0).alias("total_days"))


def _posts_up_to_pres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs within one range whose POST (r, q) is not above the PRE (r, q), per pair of cycles."""
    post = pdf["post"].to_numpy(bool)
    order = np.lexsort((~post, pdf["q"].to_numpy("int64"), pdf["r"].to_numpy("int64")))
    post, n = post[order], pdf["n"].to_numpy("int64")[order]
    codes, cycles = pd.factorize(pdf["cycle"], use_na_sentinel=False)
    codes = codes[order]
    found = []
    if post.any() and not post.all():
        pres = np.flatnonzero(~post)
        pres = pres[np.argsort(codes[pres], kind="stable")]
        own, starts = np.unique(codes[pres], return_index=True)
        for c in np.unique(codes[post]):
            upto = np.cumsum(np.where(post & (codes == c), n, 0))
            less = np.add.reduceat(upto[pres] * n[pres], starts)
            found += [(*key[:2], cycles[p], cycles[c], x) for p, x in zip(own, less) if x]
    return pd.DataFrame(found, columns=["track", "region", "pre_cycle", "post_cycle", "less"])


def period_counts(scenes: DataFrame, keys: list[str]) -> DataFrame:
    return scenes.groupBy(*keys, "period").agg(F.count("*").alias("scenes"))


def distinct_sorted(scenes: DataFrame, column: str) -> DataFrame:
    return scenes.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def footprint_coverage(scene_cells: DataFrame, basin: DataFrame, key: str, cell_area: float) -> DataFrame:
    """Basin share and area covered by each footprint, from cells."""
    total = basin.agg(F.count("*")).scalar()
    hit = scene_cells.join(basin.select("row", "col"), ["row", "col"], "left_semi")
    out = hit.groupBy(key).agg(F.count("*").alias("cells")).withColumn("_t", total)
    return out.select(
        key,
        (F.col("cells") * cell_area / 1e6).alias("covered_km2"),
        F.when(F.col("_t") > 0, 100.0 * F.col("cells") / F.col("_t")).otherwise(0.0).alias("coverage_pct"),
    )


def union_coverage(scene_cells: DataFrame, basin: DataFrame, cell_area: float) -> DataFrame:
    """Area and basin share of the union of all footprints."""
    total = basin.agg(F.count("*")).scalar()
    hit = scene_cells.select("row", "col").join(basin.select("row", "col"), ["row", "col"], "left_semi").distinct()
    out = hit.agg(F.count("*").alias("cells")).withColumn("_t", total)
    return out.select(
        (F.col("cells") * cell_area / 1e6).alias("union_km2"),
        F.when(F.col("_t") > 0, 100.0 * F.col("cells") / F.col("_t")).otherwise(0.0).alias("union_pct"),
    )


def attribute_ranges(scenes: DataFrame, time: str, numeric: list[str], labels: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("scenes"), F.count_distinct(F.to_date(time)).alias("dates")]
    aggs += [f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("min", F.min), ("max", F.max))]
    aggs += [F.count_distinct(c).alias(f"distinct_{c}") for c in labels]
    return scenes.agg(*aggs)


def _hours(ts: Column, target: str) -> Column:
    return F.abs(_micros(ts) - F.unix_micros(F.lit(target).cast("timestamp"))) / 3600e6


def closest_triplets(scenes: DataFrame, keys: list[str], w: Windows, scene: str, ts: str) -> DataFrame:
    """Per acquisition geometry: latest PRE, EVENT nearest its end, earliest POST.

    A group needs an EVENT scene and one of the others. Picks are mergeable aggregates, so a
    geometry with very many scenes is reduced before the shuffle.
    """
    s = scenes.where(F.col(ts).isNotNull())
    pick = F.struct(F.col(scene).alias("scene"), F.col(ts).alias("time"))
    of = lambda p, order: F.min_by(F.when(F.col("period") == p, pick), F.when(F.col("period") == p, order))
    t = _micros(ts)
    g = s.groupBy(*keys).agg(
        of("PRE", F.struct(-t, F.col(scene))).alias("pre"),
        of("EVENT", F.struct(_hours(F.col(ts), w.event[1]), F.col(scene))).alias("event"),
        of("POST", F.struct(t, F.col(scene))).alias("post"),
    )
    return g.where("event is not null and (pre is not null or post is not null)").select(
        *keys, *[F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in ("pre", "event", "post") for c in ("scene", "time")]
    )


# Weights of a triplet's score.
LEAST_COVERAGE, MEAN_COVERAGE, SAME_PLATFORM, SAME_FRAME = 1000, 10, 25, 10


def ranked_triplets(scenes: DataFrame, keys: list[str], frame: str, w: Windows, scene: str, ts: str) -> DataFrame:
    """Scored triplets grouped with and without the frame, each scene triple once, ranked.

    ``scenes`` has coverage and platform besides the keys. Best picks have the highest coverage,
    then the time nearest to the period's reference.
    """
    targets = {"PRE": w.event[0], "EVENT": w.event[1], "POST": w.post[0]}
    s = scenes.where(F.col(ts).isNotNull() & F.col("period").isin(list(targets)))
    target = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v).cast("timestamp"))])
    away = F.abs(_micros(ts) - F.unix_micros(target[F.col("period")])) / 3600e6
    s = s.withColumn("_away", away)
    both = F.array(
        F.struct(F.lit(True).alias("with_frame"), F.col(frame).cast("string").alias("_frame")),
        F.struct(F.lit(False).alias("with_frame"), F.lit("").alias("_frame")),
    )
    s = s.select("*", F.inline(both))
    pick = F.struct(
        F.col(scene).alias("scene"), F.col(ts).alias("time"), F.col("coverage").alias("coverage"),
        F.col("platform").alias("platform"), F.col("_away").alias("away"),
    )
    order = F.struct(-F.col("coverage"), F.col("_away"), F.col(scene))
    best = lambda p: F.min_by(F.when(F.col("period") == p, pick), F.when(F.col("period") == p, order))
    g = s.groupBy(*keys, "with_frame", "_frame").agg(*[best(p).alias(p.lower()) for p in targets])
    g = g.where("pre is not null and event is not null and post is not null")
    roles = ("pre", "event", "post")
    cov = [F.col(f"{r}.coverage") for r in roles]
    same = F.size(F.array_distinct(F.filter(F.array(*[F.col(f"{r}.platform") for r in roles]), lambda p: p != ""))) <= 1
    away = sum((F.col(f"{r}.away") for r in roles[1:]), F.col("pre.away"))
    low, mean = F.least(*cov), (cov[0] + cov[1] + cov[2]) / 3.0
    bonus = F.when(same, SAME_PLATFORM).otherwise(0) + F.when(F.col("with_frame"), SAME_FRAME).otherwise(0)
    score = low * LEAST_COVERAGE + mean * MEAN_COVERAGE - away + bonus
    c = g.select(
        *keys,
        "with_frame",
        F.col("_frame").alias("frame"),
        same.alias("same_platform"),
        low.alias("min_coverage"),
        mean.alias("mean_coverage"),
        score.alias("score"),
        *[F.col(f"{r}.{x}").alias(f"{r}_{x}") for r in roles for x in ("scene", "time", "coverage", "platform")],
    )
    triple = [f"{r}_scene" for r in roles]
    rest = [x for x in c.columns if x not in triple]
    kept = c.groupBy(*triple).agg(F.max_by(F.struct(*rest), F.struct("score", "with_frame")).alias("_k"))
    kept = kept.select(*triple, "_k.*")
    return global_rank(kept, [F.desc("score"), *[F.asc(t) for t in triple]], "rank")


def scene_manifest(triplet: DataFrame, keys: list[str]) -> DataFrame:
    """Wide triplet to one row per role."""
    rows = F.array(
        *[
            F.struct(
                F.lit(r.upper()).alias("role"),
                *[F.col(f"{r}_{x}").alias(x) for x in ("scene", "time", "coverage", "platform")],
            )
            for r in ("pre", "event", "post")
        ]
    )
    return triplet.select(*keys, F.inline(rows))


def source_verdict(radar: DataFrame, optical: DataFrame, granules: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which kinds of evidence the catalogs can give, product by product, from counts only.

    ``radar``, ``optical`` (with coverage) and ``granules`` have a period each; ``pairs`` are repeat tracks.
    """

    def flags(df: DataFrame, name: str, *more: Column) -> DataFrame:
        both = [F.coalesce(F.bool_or(F.col("period") == p), F.lit(False)) for p in ("PRE", "POST")]
        return df.agg(*[b.alias(f"{name}_{p}") for b, p in zip(both, ("pre", "post"))], (both[0] & both[1]).alias(f"{name}_pre_and_post"), *more)

    covered = F.coalesce(F.bool_or(F.col("coverage") > 0), F.lit(False)).alias("optical_meets_area")
    parts = [flags(radar, "radar"), flags(optical, "optical", covered), flags(granules, "granule")]
    out = parts[0]
    for p in parts[1:]:
        for c in p.columns:
            out = out.withColumn(c, p.select(c).scalar())
    return out.withColumn("repeat_elevation_candidate", pairs.agg(F.count("*") > 0).scalar())
