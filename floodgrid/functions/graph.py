"""Connected components of edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floodgrid.functions.skew import join_hot
from floodgrid.runtime import write_and_read as materialize


# Edges that one task joins at once: the cells of a tile.
SMALL = 1 << 16


def _join_rest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``components`` of at most ``SMALL`` edges, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([pdf[[*keys, e]].rename(columns={e: "node"}) for e in ("a", "b")], ignore_index=True)
        nodes = ends.drop_duplicates().sort_values("node", kind="stable", ignore_index=True)
        # Smaller nodes have smaller numbers, so the smallest number is the label.
        number = ends.merge(nodes.reset_index(names="_i"), on=[*keys, "node"], how="left")["_i"].to_numpy()
        a, b = number[: len(pdf)], number[len(pdf) :]
        low = np.arange(len(nodes))
        while True:
            least = np.minimum(low[a], low[b])
            new = low.copy()
            for at in (a, b, low[a], low[b]):
                np.minimum.at(new, at, least)
            new = new[new]
            if np.array_equal(new, low):
                break
            low = new
        out = nodes.copy()
        out["label"] = nodes["node"].to_numpy()[low]
        return out

    schema = StructType([edges.schema[k] for k in keys])
    schema = schema.add("node", edges.schema["a"].dataType).add("label", edges.schema["a"].dataType)
    return edges.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, schema)


def components(edges: DataFrame, keys: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """(keys, a, b) to (keys, node, label): the smallest node of the component, for nodes of edges.

    Every node points to its smallest neighbour or itself and pointers are followed by doubling. The
    edges between what is left form the next graph, so each round shuffles fewer of them. Nodes of a
    giant component share a pointer; those joins take hot keys apart. What is left of the graph is
    joined in one task as soon as it is small.
    """
    keys = list(keys or [])
    edges = materialize(edges.select(*keys, "a", "b"))
    labels = None
    while True:
        size = edges.count()
        if size <= small:
            rest = _join_rest(edges, keys)
            if labels is None or not size:
                return materialize(rest) if labels is None else labels
            step = rest.select(*keys, F.col("node").alias("label"), F.col("label").alias("_next"))
            joined = join_hot(labels, step, [*keys, "label"], how="left")
            return materialize(joined.select(*keys, "node", F.coalesce("_next", "label").alias("label")))
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        while True:
            above = up.where("node <> up").select(*keys, F.col("node").alias("up"), F.col("up").alias("top"))
            # Pointers to roots have nowhere to go, and roots are where hot pointers end.
            inner = up.join(above.select(*keys, "up"), [*keys, "up"], "left_semi")
            if inner.isEmpty():
                break
            jumped = join_hot(up, above, [*keys, "up"], how="left")
            up = materialize(jumped.select(*keys, "node", F.coalesce("top", "up").alias("up")))
        if labels is None:
            labels = up.select(*keys, "node", F.col("up").alias("label"))
        else:
            step = up.select(*keys, F.col("node").alias("label"), F.col("up").alias("_next"))
            joined = join_hot(labels, step, [*keys, "label"], how="left")
            labels = materialize(joined.select(*keys, "node", F.coalesce("_next", "label").alias("label")))
        left = up.select(*keys, F.col("node").alias("a"), F.col("up").alias("_ra"))
        right = up.select(*keys, F.col("node").alias("b"), F.col("up").alias("_rb"))
        first = materialize(join_hot(edges, left, [*keys, "a"]))
        both_ends = join_hot(first, right, [*keys, "b"]).where("_ra <> _rb")
        edges = materialize(both_ends.select(*keys, F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct())
