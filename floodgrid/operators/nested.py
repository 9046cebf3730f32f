"""Components of nested masks, all thresholds from one merge tree.

Cells carry a level: how many thresholds they pass. The mask of a threshold is the cells of its level
and above, so masks are nested and components only grow as the level falls. A tile is reduced to zones
(neighbouring cells of one level) and links between zones; zones of different tiles are linked over the
borders. From the highest level down, the links of a level join components, and their sums are added up:
every link is used once, instead of labelling all cells anew for every threshold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.functions.graph import SMALL, components
from floodgrid.functions.skew import join_hot
from floodgrid.operators.grid import Grid
from floodgrid.operators.tilegraph import TILE, on_tile_border, tile_keys
from floodgrid.runtime import materialize

_HALF = ((0, 1), (1, -1), (1, 0), (1, 1))


def _zone_tile(width: int, tile: int, sums: list[str]):
    """Zones of a tile, links between them, and its border cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy("int64"), pdf["col"].to_numpy("int64")
        level = pdf["level"].to_numpy("int64")
        r0, c0 = r.min(), c.min()
        w = c.max() - c0 + 3
        size = (r.max() - r0 + 3) * w
        at = (r - r0 + 1) * w + (c - c0 + 1)
        lev = np.zeros(size, "int64")
        lev[at] = level
        label = np.full(size, size, "int64")
        label[at] = at
        around = [i * w + j for i in (-1, 0, 1) for j in (-1, 0, 1)]
        same = [lev[at + d] == level for d in around]
        while True:
            low = np.min([np.where(s, label[at + d], size) for s, d in zip(same, around)], axis=0)
            new = label.copy()
            np.minimum.at(new, label[at], low)
            new[at] = np.minimum(new[at], low)
            new[at] = new[new[at]]
            if np.array_equal(new, label):
                break
            label = new
        ids = lambda p: (p // w - 1 + r0) * width + p % w - 1 + c0
        own = label[at]
        zones, number = np.unique(own, return_inverse=True)
        out = [pd.DataFrame({"kind": 1, "a": ids(zones), "level": lev[zones], "n": np.bincount(number), **{s: np.bincount(number, pdf[s].to_numpy("float64")).astype("int64") for s in sums}})]
        links = []
        for i, j in _HALF:
            near = at + i * w + j
            ok = (lev[near] > 0) & (label[near] != own)
            links.append(np.stack((np.minimum(own[ok], label[near][ok]), np.maximum(own[ok], label[near][ok]), np.minimum(level[ok], lev[near][ok]))))
        a, b, least = np.unique(np.concatenate(links, axis=1), axis=1)
        out.append(pd.DataFrame({"kind": 2, "a": ids(a), "b": ids(b), "level": least}))
        edge = np.isin(r % tile, (0, tile - 1)) | np.isin(c % tile, (0, tile - 1))
        out.append(pd.DataFrame({"kind": 3, "a": ids(own[edge]), "level": level[edge], "row": r[edge], "col": c[edge]}))
        all_rows = pd.concat(out, ignore_index=True)
        return all_rows.reindex(columns=["kind", "row", "col", "a", "b", "level", "n", *sums]).astype("Int64")

    return run


def _merged_at_once(zones: DataFrame, links: DataFrame, levels: int, sums: list[str]) -> DataFrame:
    """``_merged`` of a small graph, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, e = pdf[pdf["b"].isna()], pdf[pdf["b"].notna()]
        ids = np.sort(z["a"].to_numpy("int64"))
        z = z.set_index("a").loc[ids]
        of = z["level"].to_numpy("int64")
        a, b = (np.searchsorted(ids, e[k].to_numpy("int64")) for k in ("a", "b"))
        weight = e["level"].to_numpy("int64")
        root = np.arange(len(ids))
        out = []
        for k in range(levels, 0, -1):
            now = weight == k
            while True:
                least = np.minimum(root[a[now]], root[b[now]])
                new = root.copy()
                for p in (root[a[now]], root[b[now]]):
                    np.minimum.at(new, p, least)
                new = new[new]
                if np.array_equal(new, root):
                    break
                root = new
            # Labels of earlier levels are followed to the end.
            while not np.array_equal(root[root], root):
                root = root[root]
            live = of >= k
            found, number = np.unique(root[live], return_inverse=True)
            if len(found):
                adds = {s: np.bincount(number, z[s].to_numpy("float64")[live]).astype("int64") for s in ("n", *sums)}
                out.append(pd.DataFrame({"level": k, "label": ids[found], **adds}))
        names = ["level", "label", "n", *sums]
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in names})

    both = zones.unionByName(links, allowMissingColumns=True).withColumn("_g", F.lit(0))
    return both.groupBy("_g").applyInPandas(run, ", ".join(["level int", "label long", "n long", *[f"{s} long" for s in sums]]))


def _merged(zones: DataFrame, links: DataFrame, levels: int, sums: list[str], small: int) -> DataFrame:
    """Components (level, label, n, sums) of every level, from the highest down."""
    if zones.count() + links.count() <= small:
        return _merged_at_once(zones, links, levels, sums)
    names = ["n", *sums]
    out, now = [], None
    for k in range(levels, 0, -1):
        fresh = zones.where(F.col("level") == k).select(F.col("a").alias("label"), *names)
        now = materialize(fresh if now is None else now.unionByName(fresh))
        step = components(links.where((F.col("level") == k) & (F.col("a") != F.col("b"))).select("a", "b").distinct())
        step = materialize(step.select("node", F.col("label").alias("_to")))
        joined = join_hot(now, step.withColumnRenamed("node", "label"), "label", how="left")
        now = materialize(joined.groupBy(F.coalesce("_to", "label").alias("label")).agg(*[F.sum(s).alias(s) for s in names]))
        out.append(now.select(F.lit(k).alias("level"), "label", *names))
        links = materialize(links.where(F.col("level") < k))
        for end in ("a", "b"):
            moved = join_hot(links, step.withColumnRenamed("node", end), end, how="left")
            links = materialize(moved.withColumn(end, F.coalesce("_to", end)).drop("_to"))
    return reduce(lambda x, y: x.unionByName(y), out)


def nested_components(cells: DataFrame, grid: Grid, levels: int, sums: list[str], tile: int = TILE, small: int = SMALL) -> DataFrame:
    """(level, label, n, sums): 8-connected components of the cells of every level from 1 to ``levels`` and above.

    ``cells`` has row, col, level (cells of level 0 are in no mask) and integer columns to add up. A label is
    a cell id of the component.
    """
    src = cells.where("level > 0").select("row", "col", F.col("level").cast("int"), *[F.col(s).cast("long") for s in sums], *tile_keys(tile))
    schema = ", ".join(["kind int, row int, col int, a long, b long, level int, n long", *[f"{s} long" for s in sums]])
    made = materialize(src.groupBy("trow", "tcol").applyInPandas(_zone_tile(grid.width, tile, sums), schema))
    zones = made.where("kind = 1").select("a", "level", "n", *sums)
    border = made.where("kind = 3").select("row", "col", "a", "level").where(on_tile_border(tile))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _HALF])
    asks = border.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "a", "level", F.explode(steps).alias("s"))
    asks = asks.select("_r", "_c", "a", "level", (F.col("_r") + F.col("s.i")).alias("row"), (F.col("_c") + F.col("s.j")).alias("col"))
    asks = asks.where(f"floor(row / {tile}) != floor(_r / {tile}) or floor(col / {tile}) != floor(_c / {tile})")
    met = asks.join(border.select("row", "col", F.col("a").alias("b"), F.col("level").alias("_l")), ["row", "col"])
    across = met.select("a", "b", F.least("level", "_l").alias("level"))
    links = made.where("kind = 2").select("a", "b", "level").unionByName(across)
    strongest = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("level").alias("level"))
    return _merged(zones, materialize(strongest), levels, sums, small)
