"""Work on the groups of a key, with hot groups dealt out in blocks and pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: A list of hot keys up to this length is broadcast; beyond it the plain join is used.
BROADCAST_KEYS = 100_000


def deal(df: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """Adds block columns ba, bb and own, and deals rows out so that each (keys, ba, bb) is one bounded group.

    A group of at most cap rows is one block (0, 0). A hotter one is cut in blocks by a hash of
    `member`, and each row goes to every pair of blocks that has its own block `own`. Two rows of
    a key then meet in exactly one group: the diagonal one if their blocks are equal, else the
    one of their two blocks (where only rows of different `own` are to be compared). No pair is
    lost and none is capped.
    """
    hot = materialise(df.groupBy(*keys).count().where(F.col("count") > cap).select(*keys, F.ceil(F.col("count") / cap).cast("int").alias("nb")), "hot")
    n = hot.count()
    if not n:
        return df.withColumns({"ba": F.lit(0), "bb": F.lit(0), "own": F.lit(0)})
    with_nb = df.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, keys, "left")
    own = F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(member), F.lit("block")), F.col("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1))
    return with_nb.withColumn("own", own).withColumn("other", other).withColumns({"ba": F.least("own", "other"), "bb": F.greatest("own", "other")}).drop("nb", "other")


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a (keys, ba, bb) in one partition, one after another."""
    return df.repartition(*keys, "ba", "bb").sortWithinPartitions(*keys, "ba", "bb")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each row's group number; groups are runs of equal keys, ba and bb."""

    def numbers(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        for k in [*keys, "ba", "bb"]:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.cumsum(change)

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            g = numbers(t)
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield t.slice(0, cut), g[:cut]
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
            rows = max(rows, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbers(t)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; parent holds each member's root and does again afterwards."""
    apart = parent[a] != parent[b]
    if not apart.any():
        return parent
    for x, y in zip(parent[a[apart]].tolist(), parent[b[apart]].tolist(), strict=True):
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent
