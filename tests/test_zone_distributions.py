"""Distributions of radar changes by zone: what is written, and percentiles from narrowed values."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid import runtime
from floodgrid.functions import quantiles
from floodgrid.operators.focal import median3
from floodgrid.queries import QUERIES
from floodgrid.queries import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_changes_are_not_written_one_by_one(spark, monkeypatch):
    """Layers, filtered layers and zoned changes are written as a row per cell; hazard has a row per scenario."""
    cells = fx.table(spark, SF, "orders").count()
    written = {}
    write = runtime.write_and_read

    def counting(df):
        out = write(df)
        if "scenario" not in out.columns:
            written[tuple(out.columns)] = out.count()
        return out

    monkeypatch.setattr(runtime, "write_and_read", counting)
    monkeypatch.setattr(quantiles, "materialize", counting)
    fx.forget()
    try:
        assert QUERIES["filter_sensitivity"](spark, SF).count() == 18
    finally:
        fx.forget()
    # The percentiles of small groups write most of their values.
    assert max(written.values()) <= 2 * cells, written


@pytest.mark.parametrize("parts, groups", [(256, 500), (1, 500), (7, 500), (256, 2)])
def test_narrowed_percentiles(spark, monkeypatch, parts, groups):
    """Even, lopsided, equal and few values, no keys, values that are no numbers, and groups without any value."""
    monkeypatch.setattr(quantiles, "BUCKETS", parts)
    monkeypatch.setattr(quantiles, "NARROWED_GROUPS", groups)
    rng = np.random.default_rng(2)
    values = {
        "even": rng.random(3000), "lopsided": np.exp(rng.random(2000) * 40), "equal": np.full(500, 0.1), "one": [3.5], None: rng.integers(-4, 5, 900),
        "endless": [-math.inf, math.inf, 1.0, 2.0], "nan": [math.nan, 1.0, 2.0, 5.0], "none": [None, None], "tiny": [5e-324, 0.0, 1e-323],
    }
    rows = [(k, i % 2, None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    df = runtime.materialize(spark.createDataFrame(rows, "k string, h int, v double").repartition(5))
    probs, plain = {"p01": 0.01, "lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}, {"n": F.count("v"), "most": F.max("v")}
    for keys in (["k"], ["k", "h"]):
        got, want = (sorted(map(str, quantiles.group_stats(df, keys, "v", probs, plain, narrow).collect())) for narrow in (True, False))
        assert got == want
    found = {r.k: r for r in quantiles.group_percentiles(df, ["k"], "v", probs, df.groupBy("k").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))).collect()}
    for k in ("even", "lopsided", "equal", "one", None):
        assert [found[k][n] for n in probs] == pytest.approx(np.quantile(values[k], list(probs.values())).tolist(), rel=1e-12)


@pytest.mark.parametrize("tile", [2, 256])
def test_median_of_several_layers(spark, tile):
    cells = {(r, c): (float((7 * r + 3 * c) % 11) if (r + 2 * c) % 4 else None, float(r * c) if c > 2 else None) for r in range(6) for c in range(6)}
    domain = [(r, c) for r in range(-1, 8) for c in range(5)]
    df = spark.createDataFrame([(*p, *v) for p, v in cells.items()], "row int, col int, a double, b double")
    out = median3(df, spark.createDataFrame(domain, "row int, col int"), ["a", "b"], (), tile, own="own_")
    want = {}
    for r, c in domain:
        near = [[cells[r + i, c + j][k] for i in (-1, 0, 1) for j in (-1, 0, 1) if cells.get((r + i, c + j), (None, None))[k] is not None] for k in (0, 1)]
        if any(near):
            want[r, c] = (*cells.get((r, c), (None, None)), *[statistics.median(n) if n else None for n in near])
    got = out.collect()
    assert len(got) == len(want) and {(x.row, x.col): (x.own_a, x.own_b, x.a, x.b) for x in got} == want
