"""Polygon outlines of masks, stitched by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgrid.operators.grid import Grid, cell_id
from floodgrid.operators.tilegraph import TILE, forest_sums, label_components
from floodgrid.runtime import write_and_read as materialize

# Sides of a cell in turning order: step to the neighbour, start and end corner (column, row offsets).
_SIDES = [((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0))]


def boundary_edges(labelled: DataFrame, grid: Grid) -> DataFrame:
    """(edge, label, side, c1, r1, c2, r2): cell sides without a mask cell on the other hand.

    Every cell sends itself to its four neighbours; a side that nobody answers is boundary.
    """
    sides = F.array(
        *[
            F.struct(
                F.lit(k).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"),
                F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by"),
            )
            for k, ((dr, dc), a, b) in enumerate(_SIDES)
        ]
    )
    e = labelled.select("label", "row", "col", F.inline(sides))
    out = e.select(
        (cell_id(grid) * 4 + F.col("side")).alias("edge"), "label", "side",
        (F.col("col") + F.col("ax")).alias("c1"), (F.col("row") + F.col("ay")).alias("r1"),
        (F.col("col") + F.col("bx")).alias("c2"), (F.col("row") + F.col("by")).alias("r2"),
        (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"),
    )
    return out.join(labelled.select("row", "col"), ["row", "col"], "left_anti").drop("row", "col")


def outline_rings(labelled: DataFrame, grid: Grid) -> DataFrame:
    """(label, ring, seq, c, r, corner): vertices of all rings in order, in cell-corner units.

    Each boundary edge has one follower, so rings are cycles of a permutation: the smallest edge
    of a cycle names the ring and the position comes from ranking the opened cycle, both by
    pointer doubling. At a vertex where two cells touch, a ring stays with its own cell.
    """
    e = materialize(boundary_edges(labelled, grid))
    here = e.select("edge", "side", F.col("c2").alias("c"), F.col("r2").alias("r"))
    there = e.select(F.col("edge").alias("next"), F.col("side").alias("_s"), F.col("c1").alias("c"), F.col("r1").alias("r"))
    turn = F.pmod(F.col("side") + 1 - F.col("_s"), F.lit(4))  # 0 right turn, 1 straight, 2 left turn
    links = here.join(there, ["c", "r"]).groupBy("edge").agg(
        F.min_by(F.struct("next", (F.col("_s") != F.col("side")).alias("bends")), turn).alias("_n")
    )
    links = materialize(links.select("edge", "_n.next", "_n.bends"))
    state = materialize(links.select("edge", "next", F.least("edge", "next").alias("ring")))
    for _ in range(max(state.count(), 2).bit_length()):
        hop = state.select(F.col("edge").alias("next"), F.col("next").alias("_n"), F.col("ring").alias("_r"))
        new = materialize(
            state.join(hop, "next").select("edge", F.col("_n").alias("next"), F.least("ring", "_r").alias("ring"), (F.col("_r") < F.col("ring")).alias("moved"))
        )
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    ring = state.select("edge", "ring")
    chain = links.join(ring, "edge")
    ends = chain.select(
        F.col("edge").alias("id"), F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1.0).alias("w")
    )
    place = forest_sums(ends).select(F.col("id").alias("edge"), F.col("total").cast("long").alias("seq"))
    return (
        e.join(chain, "edge")
        .join(place, "edge")
        .select("label", "ring", "seq", F.col("c2").alias("c"), F.col("r2").alias("r"), F.col("bends").alias("corner"))
    )


def ring_measures(rings: DataFrame) -> DataFrame:
    """(label, rings, holes, area, perimeter) in cells, from the ring vertices."""
    nxt = rings.select("label", "ring", (F.col("seq") + 1).alias("seq"), F.col("c").alias("c0"), F.col("r").alias("r0"))
    size = rings.groupBy("ring").agg(F.max("seq").alias("n"))
    wrapped = nxt.join(size, "ring").withColumn("seq", F.when(F.col("seq") > F.col("n"), 1).otherwise(F.col("seq"))).drop("n", "label")
    seg = rings.join(wrapped, ["ring", "seq"])
    cross = F.col("c0") * F.col("r") - F.col("c") * F.col("r0")
    per = seg.groupBy("label", "ring").agg((F.sum(cross) / 2.0).alias("a"), F.count("*").alias("n"))
    return per.groupBy("label").agg(
        F.count("*").alias("rings"), F.count_if(F.col("a") < 0).alias("holes"), F.sum("a").alias("area"), F.sum("n").alias("perimeter")
    )


def polygons(rings: DataFrame, grid: Grid) -> DataFrame:
    """(label, ring, vertices): corner vertices in map units, one row per ring."""
    x = grid.origin_x + F.col("c") * grid.res_x
    y = grid.origin_y + F.col("r") * grid.res_y
    pts = F.sort_array(F.collect_list(F.struct("seq", x.alias("x"), y.alias("y"))))
    return rings.where("corner").groupBy("label", "ring").agg(F.transform(pts, lambda p: F.array(p["x"], p["y"])).alias("vertices"))


# Edges of a ring that one row of ``polygon_pieces`` stands for.
PIECE = 4096


def polygon_pieces(labelled: DataFrame, grid: Grid, piece: int = PIECE, tile: int = TILE) -> DataFrame:
    """(label, part, ring, hole, shell, piece, vertices): the polygons of a mask, long rings in several rows.

    A part is a 4-connected stretch of a label, which has one shell and any number of holes. A ring is
    named by its smallest edge; that of the shell is the upper side of the part's smallest cell, so
    a hole's shell follows from the part that its edges belong to. ``vertices`` are the corners in map
    units on ``piece`` edges of the ring; pieces in order give the ring, without the first corner again. A
    piece of a long straight side may have no row. Cells of different labels must not touch.
    """
    rings = materialize(outline_rings(labelled, grid))
    parts = label_components(labelled, grid, tile=tile, diagonal=False).select(cell_id(grid).alias("_cell"), F.col("label").alias("part"))
    cell = F.floor(F.col("ring") / 4)
    named = rings.where("seq = 1").select("ring", cell.alias("_cell")).join(parts, "_cell")
    shell = F.col("part") * 4
    named = named.select("ring", "part", (F.col("ring") != shell).alias("hole"), shell.alias("shell"))
    x = grid.origin_x + F.col("c") * grid.res_x
    y = grid.origin_y + F.col("r") * grid.res_y
    pts = F.sort_array(F.collect_list(F.struct("seq", x.alias("x"), y.alias("y"))))
    cut = F.floor((F.col("seq") - 1) / piece).cast("int").alias("piece")
    pieces = rings.where("corner").groupBy("label", "ring", cut).agg(F.transform(pts, lambda p: F.array(p["x"], p["y"])).alias("vertices"))
    return pieces.join(named, "ring").select("label", "part", "ring", "hole", "shell", "piece", "vertices")
