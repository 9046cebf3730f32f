"""Repeat tracks summed without a row for a pair, against the list of all pairs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from floodgrid.operators import catalog
from floodgrid.queries import QUERIES, scene_queries

KEYS = ["track", "region", "pre_cycle", "post_cycle"]
START = datetime(2024, 1, 10)


def granules(spark, rows):
    schema = "track string, region string, cycle string, period string, begin timestamp, granule string"
    return spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], schema)


def same(spark, rows):
    g = granules(spark, rows)
    listed = catalog.repeat_pairs(g).groupBy(*KEYS).agg(F.count("*").alias("pairs"), F.sum((F.col("delta_days") * 1000).cast("decimal(20,0)")).alias("n"))
    want = {tuple(r[k] for k in KEYS): (r.pairs, None if r.n is None else int(r.n) / 1000) for r in listed.collect()}
    got = {tuple(r[k] for k in KEYS): (r.pairs, r.total_days) for r in catalog.repeat_pairs(g, sums=True).collect()}
    assert got == want
    return want


def test_halves_order_and_gaps(spark):
    """Days that end in a half of their last digit, POST before PRE, equal times, no time, one side only, no track."""
    rng = random.Random(5)
    rows = []
    for _ in range(900):
        seconds = rng.choice([43.2, 43.2, 86.4, 0.000001, 21.6]) * rng.randrange(-40, 40)
        begin = None if rng.random() < 0.05 else START + timedelta(microseconds=round(seconds * 1e6))
        rows.append((rng.choice(["", "0001", "0002", "0003"]), rng.choice(["", "01", "02"]), rng.choice(["00", "05", "29"]), rng.choice(["PRE", "POST", "EVENT", "OTHER"]), begin))
    rows += [("0009", "01", "00", "PRE", START), ("0010", "01", "00", "PRE", None), ("0010", "01", "00", "POST", START)]
    want = same(spark, rows)
    assert want["0010", "01", "00", "00"] == (1, None) and not any(k[0] in ("", "0009") for k in want)


def test_one_track_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [("0001", "01", f"{rng.randrange(4):02}", rng.choice(["PRE", "POST"]), START + timedelta(microseconds=rng.randrange(10**12))) for _ in range(3000)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert len(same(spark, rows)) == 16
    finally:
        spark.conf.unset(key)


def test_query_lists_no_pairs(spark, monkeypatch):
    rows = [("0001", "01", "00", "PRE" if i % 2 else "POST", START + timedelta(seconds=i)) for i in range(4000)]
    g = granules(spark, rows)
    monkeypatch.setattr(scene_queries, "granules", lambda spark, sf: g)
    out = QUERIES["repeat_track_pairs"](spark, "")
    assert "begin" not in out._jdf.queryExecution().executedPlan().toString()
    (row,) = out.collect()
    assert row.pairs == 4_000_000
