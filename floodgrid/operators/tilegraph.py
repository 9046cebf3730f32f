"""Flow-forest and component problems solved tile by tile, then on the tile borders.

A cell table is cut into square tiles. A small numpy step inside each tile reduces it to its
border cells; the border graph, smaller by about the tile side, is solved by pointer doubling
with joins; a second tile step or a join brings the answer back to every cell. Two passes over
the cells replace one shuffle of all cells per doubling round.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.operators.grid import Grid
from floodgrid.functions.graph import components
from floodgrid.functions.skew import join_hot
from floodgrid.runtime import materialize

TILE = 256


def tile_keys(tile: int = TILE) -> tuple[Column, Column]:
    return (
        F.floor(F.col("row") / tile).cast("int").alias("trow"),
        F.floor(F.col("col") / tile).cast("int").alias("tcol"),
    )


def on_tile_border(tile: int = TILE) -> Column:
    r, c = F.pmod("row", F.lit(tile)), F.pmod("col", F.lit(tile))
    return (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)


def positions(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted id in the sorted ids, -1 where it is not among them."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def chase(step: np.ndarray) -> np.ndarray:
    """Follow a self-looped pointer array to its fixed points; cells on loops give -1."""
    p = step
    for _ in range(int(len(step)).bit_length() + 1):
        p = p[p]
    return np.where(p[p] == p, p, -1) if len(p) else p


def upstream_sum(step: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of weights over all cells draining into each cell, itself included (-1 ends)."""
    acc, p = weight.astype("float64").copy(), step.copy()
    for _ in range(int(len(step)).bit_length() + 1):
        live = p >= 0
        if not live.any():
            break
        acc = acc + np.bincount(p[live], weights=acc[live], minlength=len(acc))
        p = np.where(live, p[np.where(live, p, 0)], -1)
    return acc


def _follow_rest(nodes: DataFrame) -> DataFrame:
    """``forest_roots`` of a graph no larger than a tile, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, step = _local_steps(pdf)
        own = np.arange(len(pdf))
        target = pdf["target"].astype("Int64")
        root = chase(np.where(target.notna().to_numpy() | (step < 0), own, step))
        found = target.array[np.where(root >= 0, root, 0)]
        return pd.DataFrame({"id": pdf["id"], "target": pd.Series(found, dtype="Int64").where(root >= 0)})

    return nodes.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "id long, target long")


def forest_roots(nodes: DataFrame, small: int = TILE * TILE) -> DataFrame:
    """(id, next, target) -> (id, target): the first target met downstream, else NULL.

    Rows that know their target, or whose path ends, leave the working set at once, so a target
    shared by many rows is never a join key. A graph no larger than a tile is followed in one task.
    """
    state = materialize(nodes.select("id", "next", "target"))
    total = state.count()
    if total <= small:
        return _follow_rest(state)
    done = state.where("target is not null or next is null").select("id", "target")
    live = state.where("target is null and next is not null")
    look = state
    for _ in range(max(total, 2).bit_length() + 1):
        if live.isEmpty():
            return done
        step = look.select(
            F.col("id").alias("next"), F.col("next").alias("_n2"), F.col("target").alias("_t2")
        )
        look = materialize(
            live.drop("target")
            .join(step, "next", "left")
            .select("id", F.col("_n2").alias("next"), F.col("_t2").alias("target"))
            .unionByName(done.select("id", F.lit(None).cast("long").alias("next"), "target"))
        )
        done = look.where("target is not null or next is null").select("id", "target")
        live = look.where("target is null and next is not null").select("id", "next", "target")
    # Only loops are left after log2(n) doublings.
    return done.unionByName(live.select("id", F.lit(None).cast("long").alias("target")))


def _sum_rest(nodes: DataFrame) -> DataFrame:
    """``forest_sums`` of a graph no larger than a tile, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, step = _local_steps(pdf)
        far = np.where(step < 0, np.arange(len(step)), step)
        for _ in range(len(step).bit_length() + 1):
            far = far[far]
        # Ways that do not end have come to the nodes of loops; those pass nothing on and have no sum.
        loop = np.unique(far[step[far] >= 0])
        step[loop] = -1
        total = upstream_sum(step, pdf["w"].to_numpy())
        total[loop] = np.nan
        return pd.DataFrame({"id": pdf["id"], "total": total})

    return nodes.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "id long, total double")


def _climb(chain: DataFrame) -> DataFrame:
    """(id, child, s) to (id, head, s): the first node up the chain that is none of it, and the weights on the way.

    Pointers up a chain are all different, so no join has a hot key. Nodes on loops never end and are left out.
    """
    inner = chain.select(F.col("id").alias("up"), F.lit(True).alias("_in"))
    first = chain.select("id", F.col("child").alias("up"), F.col("w").alias("s")).join(inner, "up", "left")
    state = materialize(first.select("id", "up", "s", F.col("_in").isNull().alias("ended")))
    for _ in range(max(state.count(), 2).bit_length() + 1):
        live = state.where("not ended")
        if live.isEmpty():
            break
        hop = state.select(F.col("id").alias("up"), F.col("up").alias("_u"), F.col("s").alias("_s"), F.col("ended").alias("_e"))
        moved = live.join(hop, "up").select("id", F.col("_u").alias("up"), (F.col("s") + F.col("_s")).alias("s"), F.col("_e").alias("ended"))
        state = materialize(state.where("ended").unionByName(moved))
    return state.where("ended").select("id", F.col("up").alias("head"), "s")


def forest_sums(nodes: DataFrame, small: int = TILE * TILE) -> DataFrame:
    """(id, next, w) -> (id, total): weights of all nodes draining through each node.

    The forest is contracted by rake and compress. Runs of nodes with a single node above are summed
    along the run and folded into one link; then all leaves are folded into the node below, which is a sum by
    key and combines before the shuffle. Only nodes with several above remain, less than half, so the
    rounds are logarithmic whatever the shape, and no join meets a main stem on one cell. As soon as
    the rest is no larger than a tile, one task ends it; folded runs then get their totals back from
    the last round to the first. Nodes on a loop have no sum.
    """
    state = materialize(nodes.select("id", "next", F.col("w").cast("double").alias("w")))
    known: list[DataFrame] = []
    folded: list[DataFrame] = []
    while True:
        size = state.count()
        if size <= small:
            if size:
                known.append(materialize(_sum_rest(state)))
            break
        above = state.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("child"))
        now = materialize(state.join(above, "id", "left"))
        chain = now.where("n = 1")
        runs = materialize(_climb(chain).join(chain.select("id", "next"), "id"))
        # The lowest node of a run: no other node of a run stands below it.
        lowest = runs.join(chain.select(F.col("child").alias("id")), "id", "left_anti")
        link = materialize(lowest.select(F.col("head").alias("id"), F.col("next").alias("_below"), F.col("s").alias("_s"), F.lit(True).alias("_run")))
        looped = chain.join(runs.select("id"), "id", "left_anti").select("id", F.lit(None).cast("double").alias("total"))
        folded.append(runs.select("id", "head", "s"))
        rest = now.where("n is null or n > 1").join(link, "id", "left")
        rest = materialize(rest.select("id", F.when(F.col("_run"), F.col("_below")).otherwise(F.col("next")).alias("next"), "w", F.coalesce("_s", F.lit(0.0)).alias("s"), F.col("n").isNull().alias("leaf")))
        known.append(rest.where("leaf").select("id", F.col("w").alias("total")))
        known.append(looped)
        # What a node sends down: the run below it, and if it is a leaf its own weight.
        sent = rest.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.sum(F.col("s") + F.when(F.col("leaf"), F.col("w")).otherwise(0.0)).alias("_add"))
        state = materialize(rest.where("not leaf").join(sent, "id", "left").select("id", "next", (F.col("w") + F.coalesce("_add", F.lit(0.0))).alias("w")))
    totals = reduce(lambda x, y: x.unionByName(y), known) if known else nodes.select("id", F.col("w").cast("double").alias("total"))
    for runs in reversed(folded):
        totals = materialize(totals)
        # Many nodes of a long run share its head.
        back = join_hot(runs, totals.withColumnRenamed("id", "head"), "head").select("id", (F.col("s") + F.col("total")).alias("total"))
        totals = totals.unionByName(back)
    return totals


def _local_steps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values("id", ignore_index=True)
    nxt = pdf["next"].fillna(-1).to_numpy("int64")
    return pdf, np.where(nxt >= 0, positions(pdf["id"].to_numpy(), nxt), -1)


def _resolve_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, step = _local_steps(pdf)
    own = np.arange(len(pdf))
    stop = pdf["stop"].to_numpy(bool) | (step < 0)
    root = chase(np.where(stop, own, step))
    at = np.where(root >= 0, root, 0)
    hit = (root >= 0) & pdf["stop"].to_numpy(bool)[at]
    ids, nxt = pdf["id"].to_numpy(), pdf["next"].to_numpy("float64", na_value=np.nan)
    out = pdf[["id"]].copy()
    out["target"] = pd.array(np.where(hit, ids[at], 0), dtype="Int64")
    out.loc[~hit, "target"] = pd.NA
    leaves = (root >= 0) & ~hit & ~np.isnan(nxt[at])
    out["exit"] = pdf["next"].astype("Int64").to_numpy()[at]
    out["exit"] = out["exit"].astype("Int64").where(leaves)
    return out


def first_downstream(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds ``target``: id of the first stop cell met downstream, the cell itself included.

    ``cells`` has id, row, col, next (NULL where flow leaves the raster) and a boolean stop.
    NULL target: no stop cell before the flow ends, leaves or loops.
    """
    tiled = cells.select("id", "row", "col", F.col("next").cast("long"), "stop", *tile_keys(tile))
    local = materialize(
        tiled.groupBy("trow", "tcol").applyInPandas(
            lambda pdf: _resolve_tile(pdf), "id long, target long, exit long"
        )
    )
    # Entry cells are the only cells other tiles ask about.
    asked = local.where("exit is not null").select(F.col("exit").alias("id")).distinct()
    entries = asked.join(local, "id", "left").select("id", F.col("exit").alias("next"), "target")
    answers = forest_roots(entries).select(F.col("id").alias("exit"), F.col("target").alias("_t"))
    open_cells = local.where("exit is not null").select("id", "exit").join(answers, "exit", "left")
    return local.where("exit is null").select("id", "target").unionByName(
        open_cells.select("id", F.col("_t").alias("target"))
    )


def _drain_tile(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, step = _local_steps(pdf)
        own = np.arange(len(pdf))
        root = chase(np.where(step < 0, own, step))
        acc = upstream_sum(step, pdf["w"].to_numpy())
        at = np.where(root >= 0, root, 0)
        r, c = pdf["row"].to_numpy() % tile, pdf["col"].to_numpy() % tile
        edge = (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)
        nxt = pdf["next"].astype("Int64")
        out = pd.DataFrame({"id": pdf["id"], "is_root": root == own, "acc": acc})
        out["exit"] = pd.Series(nxt.to_numpy()[at], dtype="Int64").where(root >= 0)
        return out[edge]

    return run


def _fill_tile(key, cells: pd.DataFrame, inflow: pd.DataFrame) -> pd.DataFrame:
    if cells.empty:
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "total": pd.Series(dtype="float64")})
    pdf, step = _local_steps(cells)
    w = pdf["w"].to_numpy("float64").copy()
    if len(inflow):
        at = positions(pdf["id"].to_numpy(), inflow["id"].to_numpy())
        ok = at >= 0
        np.add.at(w, at[ok], inflow["total"].to_numpy()[ok])
    return pd.DataFrame({"id": pdf["id"], "total": upstream_sum(step, w)})


def accumulate(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(id, row, col, next, w) -> (id, total): weights of all cells upstream, itself included."""
    tiled = cells.select(
        "id", "row", "col", F.col("next").cast("long"), F.col("w").cast("double"), *tile_keys(tile)
    )
    border = materialize(
        tiled.groupBy("trow", "tcol").applyInPandas(
            _drain_tile(tile), "id long, is_root boolean, acc double, exit long"
        )
    )
    sent = (
        border.where("is_root and exit is not null")
        .groupBy(F.col("exit").alias("id"))
        .agg(F.sum("acc").alias("w"))
    )
    entries = sent.join(border.select("id", F.col("exit").alias("next")), "id", "left")
    # An exit that enters no known cell carries its water nowhere; drop the dangling pointer.
    known = sent.select(F.col("id").alias("next"))
    linked = entries.where("next is not null").join(known, "next", "left_semi")
    ends = entries.where("next is null")
    inflow = forest_sums(linked.select("id", "next", "w").unionByName(ends.select("id", "next", "w")))
    at = inflow.select(
        "id",
        "total",
        F.expr(f"cast(id div {grid.width} as int)").alias("row"),
        F.expr(f"cast(id % {grid.width} as int)").alias("col"),
    ).select("id", "total", *tile_keys(tile))
    return (
        tiled.groupBy("trow", "tcol")
        .cogroup(at.groupBy("trow", "tcol"))
        .applyInPandas(_fill_tile, "id long, total double")
    )


def _label_tile(keys: list[str], width: int, diagonal: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy("int64"), pdf["col"].to_numpy("int64")
        r0, c0 = r.min(), c.min()
        h, w = r.max() - r0 + 1, c.max() - c0 + 1
        size = (h + 2) * (w + 2)
        pos = (r - r0 + 1) * (w + 2) + (c - c0 + 1)
        big = size
        lab = np.full(size + 1, big, dtype="int64")
        lab[pos] = pos
        around = [dr * (w + 2) + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if diagonal or not (dr and dc)]
        while True:
            low = np.min([lab[pos + d] for d in around], axis=0)
            new = lab.copy()
            np.minimum.at(new, lab[pos], low)
            new[pos] = np.minimum(new[pos], low)
            new[pos] = new[new[pos]]
            if np.array_equal(new, lab):
                break
            lab = new
        own = lab[pos]
        rows, cols = own // (w + 2) - 1 + r0, own % (w + 2) - 1 + c0
        out = pdf[[*keys, "row", "col"]].copy()
        out["label"] = rows * width + cols
        return out

    return run


def label_components(
    mask: DataFrame, grid: Grid, keys: Iterable[str] = (), tile: int = TILE, with_piece: bool = False, diagonal: bool = True
) -> DataFrame:
    """8-connected components per key, 4-connected without ``diagonal``; ``label`` is the smallest cell id of the component.

    ``with_piece`` keeps the label inside the tile too: a key of at most tile x tile cells for
    joins that a giant component would make lopsided.
    """
    keys = list(keys)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in mask.select(*keys).schema] if keys else []
    schema = ", ".join([*fields, "row int", "col int", "label long"])
    local = materialize(
        mask.select(*keys, "row", "col")
        .distinct()
        .withColumns({"trow": tile_keys(tile)[0], "tcol": tile_keys(tile)[1]})
        .groupBy(*keys, "trow", "tcol")
        .applyInPandas(_label_tile(keys, grid.width, diagonal), schema)
    )
    border = local.where(on_tile_border(tile))
    ways = ((0, 1), (1, -1), (1, 0), (1, 1)) if diagonal else ((0, 1), (1, 0))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ways])
    asks = border.select(*keys, "row", "col", F.col("label").alias("a"), F.explode(steps).alias("s")).select(
        *keys,
        F.expr(f"floor(row / {tile}) as r0"),
        F.expr(f"floor(col / {tile}) as c0"),
        (F.col("row") + F.col("s.dr")).alias("row"),
        (F.col("col") + F.col("s.dc")).alias("col"),
        "a",
    )
    asks = asks.where(f"floor(row / {tile}) != r0 or floor(col / {tile}) != c0")
    met = asks.join(border.select(*keys, "row", "col", F.col("label").alias("b")), keys + ["row", "col"])
    edges = met.where("a != b").select(*keys, "a", "b").distinct()
    merged = components(edges, keys).select(
        *keys, F.col("node").alias("label"), F.col("label").alias("_to")
    )
    piece = [F.col("label").alias("piece")] if with_piece else []
    return local.join(merged, keys + ["label"], "left").select(
        *keys, "row", "col", *piece, F.coalesce("_to", "label").alias("label")
    )
