"""Embedding near-duplicates: iterative quantisation, Hamming tables over the codes, and a rerank with the vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .groups import deal, together, unite, whole_groups
from .store import materialise

#: Vectors at most that the rotations are learned from, those of least hash of their id.
FIT_VECTORS = 8192
ROUNDS = 30
#: Aimed-at share of pairs at the threshold itself that share a table's key; closer pairs are found more often.
RECALL = 0.98
#: Vectors wanted in a key of a table, and vectors of a group that one task compares.
PER_KEY, GROUP_CAP = 4, 4096


def rotations(x: np.ndarray, n_bits: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dims x n_bits): iterative quantisation from as many random starts as n_bits takes.

    Each start rotates the principal axes of centred x at random; then signs B of x R and the
    orthogonal R nearest to x^T B take turns, which balances the bits and lessens the loss of
    quantising.
    """
    mean = x.mean(axis=0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1]
    v = c @ axes
    rng = np.random.default_rng(seed)
    out = []
    while sum(r.shape[1] for r in out) < n_bits:
        r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = u @ w
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)[:, :n_bits]


def tables_for(largest: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables): keys hold about PER_KEY vectors of the largest label, and tables suffice for RECALL at the threshold.

    Two vectors at angle a differ in a given bit with a chance of about a / pi.
    """
    bits = min(24, max(6, ceil(log2(max(2, largest / PER_KEY)))))
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, max(1, ceil(log(1 - RECALL) / log(1 - same)))


def _can_link() -> Column:
    """Whether a row (id, v, label) can link."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cap: int = GROUP_CAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links between vectors of equal label, equal length and cosine of threshold or more.

    Equal vectors of a label are one class, told by its least id, and never expanded into pairs. A
    class goes to one key of every table; classes of a key are compared whole with their vectors in
    double precision, and a pair counts only in the first table whose key it shares. Null, zero and
    not finite vectors, null labels and null ids link with nothing: they have n_links 0 and their
    own id as component. An id that is repeated is so many vectors. No rows give no rows.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = every.where(_can_link())
    classes = materialise(rows.groupBy("label", "v").agg(F.min("id").alias("cls"), F.count("*").alias("copies")).withColumn("key", F.xxhash64("label", "v", "cls")), "classes")
    largest = classes.groupBy("label", F.size("v").alias("d")).count().agg(F.max("count"), F.max("d")).first()
    links = None
    if largest[0]:
        dims = largest[1]
        bits, n_tables = tables_for(largest[0], threshold)

        def padded(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
            x = column.to_pylist()
            out = np.zeros((len(x), dims))
            for i, v in enumerate(x):
                out[i, : len(v)] = v
            out /= np.abs(out).max(axis=1, keepdims=True)
            return out / np.linalg.norm(out, axis=1, keepdims=True)

        sample = classes.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(FIT_VECTORS).toArrow()
        sent = spark.sparkContext.broadcast(rotations(padded(sample.column("v")), bits * n_tables))

        def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, r = sent.value
            for b in batches:
                x = padded(b.column("v"))
                codes = ((x - mean) @ r >= 0).reshape(len(x), n_tables, bits) @ (1 << np.arange(bits))
                for t in range(n_tables):
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns, pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(codes[:, t].astype(np.int64)), pa.array(list(codes.astype("<i4")), pa.list_(pa.int32()))],
                        names=[*b.schema.names, "table", "code", "codes"],
                    )

        small = classes.select("key", F.xxhash64("label", F.size("v")).alias("pool"), "v", "copies")
        indexed = small.mapInArrow(hashed, "key long, pool long, v array<double>, copies long, table int, code long, codes array<int>")
        dealt = deal(indexed, ["table", "pool", "code"], "key", cap)

        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, g in whole_groups(batches, ["table", "pool", "code"], rows=20_000):
                key, own, copies, table = (t.column(c).to_numpy() for c in ("key", "own", "copies", "table"))
                across = t.column("ba").to_numpy() != t.column("bb").to_numpy()
                starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
                x = padded(t.column("v"))
                codes = np.array(t.column("codes").to_pylist(), dtype=np.int32).reshape(len(key), -1)
                links = np.zeros(len(key), dtype=np.int64)
                parent = np.arange(len(key))
                for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    for i in range(a, z, 512):
                        j = min(i + 512, z)
                        near = x[i:j] @ x[a:z].T >= threshold
                        near[np.arange(j - i), np.arange(i - a, j - a)] = False
                        if across[a]:
                            near &= own[i:j, None] != own[None, a:z]
                        if not near.any():
                            continue
                        p, q = np.nonzero(near)
                        parent = unite(parent, p + i, q + a)
                        for earlier in range(int(table[a])):
                            near &= codes[i:j, earlier][:, None] != codes[None, a:z, earlier]
                        links[i:j] += near @ copies[a:z]
                keep = np.flatnonzero((links > 0) | (parent != np.arange(len(key))))
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(links[keep]), pa.array(key[parent[keep]])], names=["key", "n", "to"])

        links = materialise(together(dealt, ["table", "pool", "code"]).mapInArrow(compare, "key long, n long, to long"), "vector-links")
    of = classes.select("key", "label", "v", "cls", "copies")
    if links is not None:
        roots = connected_components(links.select(F.col("key").alias("a"), F.col("to").alias("b")))
        counts = links.groupBy("key").agg(F.sum("n").alias("n"))
        of = of.join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        low = of.groupBy("root").agg(F.min("cls").alias("component"))
        of = of.join(low, "root").select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component")
    else:
        of = of.select("label", "v", F.lit(0).cast("long").alias("n"), F.col("cls").alias("component"))
    linked = rows.join(materialise(of, "vector-classes"), ["label", "v"]).select("id", "n", "component")
    rest = every.where(~_can_link()).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return linked.unionByName(rest).select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
