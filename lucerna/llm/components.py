"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _forest(batches):
    """Spanning forest of each batch of edges: members point at the least node; fewer rows, the same components."""
    for edges in batches:
        nodes, ends = np.unique(edges[["a", "b"]].to_numpy(dtype=np.int64), return_inverse=True)
        ends = ends.reshape(-1, 2)
        root = np.arange(len(nodes))
        while True:  # the least root of the neighbours, then shortcuts, until nothing moves
            low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
            new = root.copy()
            for side in (0, 1):
                np.minimum.at(new, root[ends[:, side]], low)
                np.minimum.at(new, ends[:, side], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[child], "b": nodes[root[child]]})


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges u-v with m, the least of u and its neighbours. Keys are inverted for the join, so that both sides are
    exchanged anew and Spark can split a hub."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.bitwise_not("u").alias("k"), "m")
    return edges.join(least, F.bitwise_not("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of its component, for every node (bigint) of ``edges`` that isn't a root itself.

    Self-loops and repeated edges don't matter; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").mapInPandas(_forest, "a long, b long")
    now = materialise(pairs.distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _with_least(down)
        last, now = now, materialise(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        discard(last)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
