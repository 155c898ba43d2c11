"""Connected components by alternating star contraction, for graphs of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import unite
from .store import discard, materialise


def _sign(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())


def _at_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v) of a task."""
    links = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches]
    if links:
        nodes, at = np.unique(np.concatenate(links, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = nodes[unite(np.arange(len(nodes)), a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialise, few: int = 0) -> DataFrame:
    """(a, b) long pairs -> (node, root) for each node that has a link; root is its component's least node.

    Large star: a node's greater neighbours take its least neighbour. Small star: its lesser
    neighbours do. Each is a grouped minimum, which combines before the shuffle, and an equi-join of
    links with one row a node; a hub's links are rows, never one list, and adaptive skew joins deal
    them out over tasks. The number of rounds grows with the logarithm of the
    number of nodes. Every round is written to the shared folder by
    `keep`. Links up to `few` are
    joined in one task, with no rounds. Loops and nulls are dropped;
    repeated and reversed pairs count once; no pairs give no rows.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = _sign(now)
    if 0 < sign[0] <= few:
        return now.repartition(1).mapInArrow(_at_once, "node long, root long")
    while sign[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = keep(small, "links")
        before, sign = sign, _sign(after)
        discard(now)
        now = after
        if sign == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
