"""Depression handling: filling, least-cost breaching, routing across flats.

Tiles are flooded on their own; how water passes from tile to tile is a small graph of border
labels and lowest passes, solved with joins; the answer is then applied to every cell.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.operators import hydro
from floodgrid.operators.focal import neighbourhood
from floodgrid.operators.grid import Grid
from floodgrid.operators.tilegraph import TILE, on_tile_border, tile_keys
from floodgrid.runtime import write_and_read as materialize

OUTSIDE = -1
_AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def _flood_tile(tile: int, width: int):
    """Local water levels: every border cell floods its surroundings under its own label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, z = (pdf[k].to_numpy() for k in ("row", "col", "value"))
        height = {(a, b): h for a, b, h in zip(r.tolist(), c.tolist(), z.tolist())}
        level, label, passes, heap = {}, {}, {}, []

        def note(a: int, b: int, w: float) -> None:
            key = (a, b) if a < b else (b, a)
            if w < passes.get(key, np.inf):
                passes[key] = w

        for (a, b), h in height.items():
            edge = a % tile in (0, tile - 1) or b % tile in (0, tile - 1)
            open_side = any(
                (a + da, b + db) not in height and (a + da) // tile == a // tile and (b + db) // tile == b // tile
                for da, db in _AROUND
            )
            if edge or open_side:
                own = a * width + b if edge else OUTSIDE
                level[a, b], label[a, b] = h, own
                heapq.heappush(heap, (h, a, b))
                if edge and open_side:
                    note(own, OUTSIDE, h)
        while heap:
            h, a, b = heapq.heappop(heap)
            for da, db in _AROUND:
                n = (a + da, b + db)
                if n not in height:
                    continue
                if n not in level:
                    level[n], label[n] = max(height[n], h), label[a, b]
                    heapq.heappush(heap, (level[n], *n))
                elif label[n] != label[a, b]:
                    note(label[a, b], label[n], max(h, level[n]))
        cells = list(zip(r.tolist(), c.tolist()))
        out = pd.DataFrame(
            {"is_cell": True, "row": r, "col": c, "value": z, "a": [label.get(k, OUTSIDE) for k in cells], "b": 0, "w": [level.get(k, np.nan) for k in cells]}
        )
        if passes:
            p = pd.DataFrame([(a, b, w) for (a, b), w in passes.items()], columns=["a", "b", "w"])
            p = p.assign(is_cell=False, row=0, col=0, value=0.0)
            out = pd.concat([out, p[out.columns]])
        return out

    return run


def lowest_passes(edges: DataFrame) -> DataFrame:
    """(node, level): lowest possible highest pass on the way from each node to OUTSIDE.

    Every node moves over its lowest pass; the trees this makes are contracted and the rest goes
    on with the passes between them, so the number of rounds is logarithmic.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != OUTSIDE)
    graph = materialize(both.groupBy("a", "b").agg(F.min("w").alias("w")))
    known = materialize(graph.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(float("-inf")).alias("pass")))
    while not graph.isEmpty():
        order = F.struct("w", F.least("a", "b"), F.greatest("a", "b"))
        pick = graph.groupBy("a").agg(F.min_by(F.struct("b", "w"), order).alias("_p")).select("a", F.col("_p.b").alias("next"), F.col("_p.w").alias("pass"))
        back = pick.select(F.col("a").alias("next"), F.col("next").alias("_back"))
        # Two nodes that choose each other: the smaller one stays as the root of the tree. Nodes
        # that drain outside have no partner and would all meet on one key.
        leaving = pick.where(F.col("next") == OUTSIDE).withColumn("_back", F.lit(None).cast("long"))
        tree = pick.where(F.col("next") != OUTSIDE).join(back, "next", "left").unionByName(leaving).select(
            "a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("next")), F.col("a")).otherwise(F.col("next")).alias("next"), "pass"
        )
        tree = tree.select("a", "next", F.when(F.col("a") == F.col("next"), float("-inf")).otherwise(F.col("pass")).alias("pass"))
        state = materialize(tree.withColumn("done", (F.col("next") == OUTSIDE) | (F.col("a") == F.col("next"))))
        while True:
            live = state.where("not done")
            if live.isEmpty():
                break
            hop = state.select(F.col("a").alias("next"), F.col("next").alias("_n"), F.col("pass").alias("_p"), F.col("done").alias("_d"))
            moved = live.drop("done").join(hop, "next").select("a", F.col("_n").alias("next"), F.greatest("pass", "_p").alias("pass"), F.col("_d").alias("done"))
            state = materialize(state.where("done").unionByName(moved))
        trees = state.select("a", F.col("next").alias("_root"), F.col("pass").alias("_p"))
        moved = known.where(F.col("root") != OUTSIDE).join(trees.withColumnRenamed("a", "root"), "root").select(
            "node", F.col("_root").alias("root"), F.greatest("pass", "_p").alias("pass")
        )
        known = materialize(known.where(F.col("root") == OUTSIDE).unionByName(moved))
        left = graph.join(trees.select("a", F.col("_root").alias("ra"), F.col("_p").alias("pa")), "a")
        right = trees.select(F.col("a").alias("b"), F.col("_root").alias("rb"), F.col("_p").alias("pb"))
        # Passes to the outside need no root.
        outer = left.where(F.col("b") == OUTSIDE)
        joined = left.where(F.col("b") != OUTSIDE).join(right, "b").unionByName(outer, allowMissingColumns=True).select(
            F.col("ra").alias("a"),
            F.coalesce("rb", "b").alias("b"),
            F.greatest("w", "pa", F.coalesce("pb", F.lit(float("-inf")))).alias("w"),
        )
        graph = materialize(joined.where((F.col("a") != F.col("b")) & (F.col("a") != OUTSIDE)).groupBy("a", "b").agg(F.min("w").alias("w")))
    return known.where(F.col("root") == OUTSIDE).select("node", F.col("pass").alias("level"))


def fill_depressions(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(row, col, value, filled): the lowest surface above the terrain that drains to its border."""
    src = cells.where(F.col("value").isNotNull()).select("row", "col", F.col("value").cast("double"), *tile_keys(tile))
    flooded = materialize(
        src.groupBy("trow", "tcol").applyInPandas(
            _flood_tile(tile, grid.width), "is_cell boolean, row int, col int, value double, a long, b long, w double"
        )
    )
    tiles = flooded.where("is_cell")
    border = tiles.where(on_tile_border(tile)).select("row", "col", "value", F.col("a").alias("label"))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in _AROUND])
    asks = border.select(
        "label", F.col("value").alias("_z"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(steps).alias("s")
    ).select("label", "_z", "_r", "_c", (F.col("_r") + F.col("s.dr")).alias("row"), (F.col("_c") + F.col("s.dc")).alias("col"))
    asks = asks.where(f"floor(row / {tile}) != floor(_r / {tile}) or floor(col / {tile}) != floor(_c / {tile})")
    met = asks.join(border.select("row", "col", F.col("label").alias("_to"), F.col("value").alias("_zt")), ["row", "col"], "left")
    # No neighbour across the tile side: water leaves the raster there.
    across = met.select(
        F.col("label").alias("a"), F.coalesce("_to", F.lit(OUTSIDE)).cast("long").alias("b"), F.greatest("_z", F.coalesce("_zt", "_z")).alias("w")
    )
    levels = lowest_passes(flooded.where("not is_cell").select("a", "b", "w").unionByName(across).where("a != b"))
    # Cells that already drain to the border or a gap share one label and have no level to look up.
    drained = tiles.where(F.col("a") == OUTSIDE)
    raised = tiles.where(F.col("a") != OUTSIDE).join(levels.withColumnRenamed("node", "a"), "a", "left")
    return raised.unionByName(drained, allowMissingColumns=True).select("row", "col", "value", F.greatest("w", F.coalesce("level", F.col("w"))).alias("filled"))


def _spread_flats(pdf: pd.DataFrame) -> pd.DataFrame:
    """Steps to the nearest drained cell over cells of the same height, and the way there."""
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    r0, c0 = r.min() - 1, c.min() - 1
    shape = (r.max() - r0 + 2, c.max() - c0 + 2)
    z = np.full(shape, np.nan)
    d = np.full(shape, np.inf)
    i, j = r - r0, c - c0
    z[i, j] = pdf["value"].to_numpy()
    d[i, j] = pdf["d"].fillna(np.inf).to_numpy()
    fixed = d == 0
    while True:
        best = d.copy()
        for dr, dc in hydro.D8.values():
            nz, nd = np.roll(z, (-dr, -dc), (0, 1)), np.roll(d, (-dr, -dc), (0, 1))
            best = np.where(nz == z, np.minimum(best, nd + 1), best)
        best[fixed] = 0
        if np.array_equal(best, d):
            break
        d = best
    code = np.zeros(shape, dtype="int64")
    for k, (dr, dc) in reversed(list(hydro.D8.items())):
        nz, nd = np.roll(z, (-dr, -dc), (0, 1)), np.roll(d, (-dr, -dc), (0, 1))
        code = np.where((nz == z) & (nd == d - 1) & (d > 0) & np.isfinite(d), k, code)
    out = pdf.copy()
    out["d"] = np.where(np.isfinite(d[i, j]), d[i, j], np.nan)
    out["way"] = code[i, j]
    return out[out["own"]][["row", "col", "value", "pointer", "d", "way"]]


def route_flats(pointers: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """Pointers for cells without a lower neighbour: along the flat to its nearest drained cell.

    Works only on flats and the cells next to them. Tiles exchange their border distances until
    nothing changes, so the rounds follow the number of tiles a flat crosses, not its cells.
    Cells on the raster border keep pointer 0: water leaves there.
    """
    border = (F.col("row").isin(0, grid.height - 1)) | (F.col("col").isin(0, grid.width - 1))
    around = neighbourhood(pointers.select("row", "col", "value", "pointer"), "value")
    gap = F.exists("nb", lambda x: x.isNull())
    same = F.size(F.filter("nb", lambda x: x == F.col("value"))) > 1
    part = around.where(same).select(
        "row", "col", "value", "pointer", F.when((F.col("pointer") > 0) | border | gap, 0.0).alias("d"), F.lit(0).cast("long").alias("way")
    )
    state = materialize(part)
    seen = -1
    while True:
        left = state.where("d is null").count()
        total = state.agg(F.sum("d")).first()[0]
        if seen == (left, total):
            break
        seen = (left, total)
        own = state.select("row", "col", "value", "pointer", "d", F.lit(True).alias("own"), *tile_keys(tile))
        steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in _AROUND])
        halo = state.where(on_tile_border(tile)).select("row", "col", "value", "pointer", "d", F.lit(False).alias("own"), F.explode(steps).alias("s"))
        halo = halo.select(
            "row", "col", "value", "pointer", "d", "own",
            F.floor((F.col("row") + F.col("s.dr")) / tile).cast("int").alias("trow"), F.floor((F.col("col") + F.col("s.dc")) / tile).cast("int").alias("tcol"),
        ).where(f"trow != floor(row / {tile}) or tcol != floor(col / {tile})").distinct()
        state = materialize(
            own.unionByName(halo).groupBy("trow", "tcol").applyInPandas(_spread_flats, "row int, col int, value double, pointer int, d double, way long")
        )
    ways = state.where("way > 0 and pointer = 0").select("row", "col", F.col("way").cast("int").alias("_w"))
    return pointers.join(ways, ["row", "col"], "left").withColumn("pointer", F.coalesce("_w", "pointer")).drop("_w")


def filled_flow(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """Fill, pointers on the filled surface, flats routed: (row, col, value, pointer, id, next)."""
    filled = materialize(fill_depressions(cells, grid, tile).select("row", "col", F.col("filled").alias("value")))
    return hydro.with_next(route_flats(hydro.d8_pointer(filled, grid), grid, tile), grid, within=filled)


def _breach_tile(dist: int, res_x: float, res_y: float):
    """Cheapest carve from each own pit to lower ground within ``dist`` cells."""
    moves = [(dr, dc, float(np.hypot(dc * res_x, dr * res_y))) for dr, dc in _AROUND]

    def carve(height: dict, pit: tuple[int, int]):
        low = height[pit]
        cost, came, heap = {pit: 0.0}, {}, [(0.0, pit)]
        while heap:
            spent, at = heapq.heappop(heap)
            if spent > cost[at]:
                continue
            if height[at] < low:
                path = [at]
                while path[-1] != pit:
                    path.append(came[path[-1]])
                return path[::-1]
            for dr, dc, run in moves:
                n = (at[0] + dr, at[1] + dc)
                if n not in height or max(abs(n[0] - pit[0]), abs(n[1] - pit[1])) > dist:
                    continue
                total = spent + max(height[n] - low, 0.0) * run + 1e-9 * run
                if total < cost.get(n, np.inf):
                    cost[n], came[n] = total, at
                    heapq.heappush(heap, (total, n))
        return None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        height = {(r, c): z for r, c, z in zip(pdf["row"].tolist(), pdf["col"].tolist(), pdf["value"].tolist())}
        rows = []
        for r, c in pdf.loc[pdf["pit"] & pdf["own"], ["row", "col"]].itertuples(index=False):
            path = carve(height, (r, c))
            if path:
                top, end, n = height[r, c], height[path[-1]], len(path) - 1
                rows += [(a, b, top + (end - top) * k / n) for k, (a, b) in enumerate(path) if 0 < k < n]
        return pd.DataFrame(rows, columns=["row", "col", "value"]).astype({"row": "int32", "col": "int32", "value": "float64"})

    return run


def breach_depressions(cells: DataFrame, grid: Grid, dist: int, tile: int = TILE) -> DataFrame:
    """(row, col, value, breached): pits connected to lower ground within ``dist`` cells.

    Each pit is judged on the original terrain, so the result does not depend on the tiling;
    where carved paths meet the lower bed counts. Pits that find no way stay, for filling.
    """
    src = cells.where(F.col("value").isNotNull()).select("row", "col", F.col("value").cast("double"))
    around = neighbourhood(src, "value")
    inner = ~F.exists("nb", lambda x: x.isNull())
    lowest = ~F.exists("nb", lambda x: x < F.col("value"))
    marked = materialize(around.select("row", "col", "value", (inner & lowest).alias("pit")))
    spans = lambda c: F.sequence(
        F.floor((F.col(c) - dist) / tile).cast("int"), F.floor((F.col(c) + dist) / tile).cast("int")
    )
    tiles = marked.where("pit").select(*tile_keys(tile)).distinct()
    # Cells are copied to the tiles in reach only if their own tile is near one with a pit.
    reach = -(-dist // tile)
    near = F.explode(F.sequence(F.col("trow") - reach, F.col("trow") + reach)).alias("trow")
    wanted = tiles.select(near, "tcol").select("trow", F.explode(F.sequence(F.col("tcol") - reach, F.col("tcol") + reach)).alias("tcol")).distinct()
    at = [t.alias(n) for t, n in zip(tile_keys(tile), ("trow", "tcol"))]
    close = marked.select("row", "col", "value", "pit", *at).join(wanted, ["trow", "tcol"], "left_semi")
    spread = close.select("row", "col", "value", "pit", F.explode(spans("row")).alias("trow")).select("*", F.explode(spans("col")).alias("tcol"))
    own = (F.floor(F.col("row") / tile) == F.col("trow")) & (F.floor(F.col("col") / tile) == F.col("tcol"))
    # Only tiles that hold a pit are looked at.
    work = spread.withColumn("own", own).join(tiles, ["trow", "tcol"], "left_semi")
    beds = work.groupBy("trow", "tcol").applyInPandas(
        _breach_tile(dist, abs(grid.res_x), abs(grid.res_y)), "row int, col int, value double"
    )
    cut = beds.groupBy("row", "col").agg(F.min("value").alias("_bed"))
    return src.join(cut, ["row", "col"], "left").withColumn("breached", F.least("value", F.coalesce("_bed", "value"))).drop("_bed")


def breach_then_fill(cells: DataFrame, grid: Grid, dist: int, tile: int = TILE) -> DataFrame:
    """(row, col, value, conditioned)"""
    b = materialize(breach_depressions(cells, grid, dist, tile))
    f = fill_depressions(b.select("row", "col", F.col("breached").alias("value")), grid, tile)
    return b.select("row", "col", "value").join(f.select("row", "col", F.col("filled").alias("conditioned")), ["row", "col"])


