"""Layer names, buffers, gap values and the entry without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgrid.operators import distance, focal, sar
from floodgrid.operators.grid import Grid


@pytest.mark.parametrize(
    "name,kind",
    [
        ("S1A_localincangle.tif", "INC"), ("S1_inc_mapped.tif", "INC"), ("my_incidence-angle2.tif", "INC"), ("a.vv.tif", "OTHER"), ("VV", "VV"), ("vv.tif", "VV"),
        ("x-VH_1.tif", "VH"), ("xvv_1.tif", "OTHER"), ("x_vvh.tif", "OTHER"), ("x_vv_inc_map.tif", "VV"), ("s1_ls_map.tif", "LS"), ("s1_lsmap.tif", "OTHER"), ("Layover.tif", "LS"),
        ("since_map.tif", "INC"), ("inc.tif", "OTHER"), ("", "OTHER"),
    ],
)
def test_layer_kinds(spark, name, kind):
    assert spark.createDataFrame([(name,)], "n string").select(sar.layer_kind(F.col("n"))).first()[0] == kind


@pytest.mark.parametrize("res,reach", [((1.0, 1.0), 2.5), ((2.0, 1.0), 3.0), ((1.0, -3.0), 3.5), ((1.0, 1.0), 0.0)])
def test_buffers_in_map_units(spark, raster, res, reach):
    rng = np.random.default_rng(1)
    mask = rng.random((14, 17)) < 0.05
    g = Grid(17, 14, 0.0, 0.0, *res)
    got = {(r.row, r.col) for r in distance.buffer_cells(raster(np.where(mask, 1.0, np.nan)), g, reach).collect()}
    cells = list(zip(*np.nonzero(mask)))
    want = {(i, j) for i in range(14) for j in range(17) if any(np.hypot((i - a) * res[1], (j - b) * res[0]) <= reach for a, b in cells)}
    assert got == want


def test_no_median_without_a_gap(spark, raster, monkeypatch):
    made = []
    median = focal.median_value
    monkeypatch.setattr(focal, "median_value", lambda *a: made.append(1) or median(*a))
    a = np.random.default_rng(2).random((6, 7))
    focal.horn_slope(raster(a), Grid(7, 6)).collect()
    focal.hillshade(raster(a), Grid(7, 6)).collect()
    assert not made
    a[2, 3] = np.nan
    focal.horn_slope(raster(a), Grid(7, 6)).collect()
    assert made


def test_entry_without_a_library_of_the_subpackage():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert len(e.queries()) > 150 and 'op1_quality_rules' not in e.queries(); assert 'raster_profile' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
