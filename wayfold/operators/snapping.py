"""Reference-guided snapping of a network: components of nodes that share lines, each worked through in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import snap_nodes
from .network import best_connexion
from .roads import cut


def labelled(edges: DataFrame) -> DataFrame:
    """(line_id, component) for lines linked by (line_id, node): the least line of each component, by passing least labels on until none changes."""
    now = cut(edges.select("line_id", "node", F.col("line_id").alias("c")))
    while True:
        by_node = now.groupBy("node").agg(F.min("c").alias("n"))
        by_line = now.join(by_node, "node").groupBy("line_id").agg(F.min("n").alias("m"))
        # a label is itself a line, whose own label may be less by now
        jump = by_line.select(F.col("line_id").alias("m"), F.col("m").alias("j"))
        label = by_line.join(jump, "m", "left").select("line_id", F.least("m", F.coalesce("j", "m")).alias("c2"))
        new = cut(now.join(label, "line_id"))
        if not new.where("c2 <> c").head(1):
            return new.select("line_id", F.col("c2").alias("component")).distinct()
        now = new.select("line_id", "node", F.col("c2").alias("c"))


def snap_advanced(v: DataFrame, members: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(lines, warnings): ends that are one node in the reference are brought together in v.

    members: (node, x, y, id, line_id, is_end, heading, class, score, updatable), where x and y are
    the node's place in the reference. Nodes that share a line depend on one another, so each
    component of them is one group and goes by place; components are independent.
    """
    pair = best_connexion(members.select("node", "id", "heading", "class", "score"))
    comp = labelled(members.select("line_id", "node").distinct())
    lines = v.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).join(comp, "line_id")
    nodes = members.groupBy("node", "x", "y").agg(F.array_sort(F.collect_list(F.struct("id", "line_id", "is_end", "updatable"))).alias("m"), F.min("line_id").alias("line_id")).join(pair, "node").join(comp.withColumnRenamed("component", "group"), "line_id").drop("line_id")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {c: [] for c in ("line_id", "seq", "x", "y", "message", "ids")}

        def add(*values: object) -> None:
            for c, x in zip(rows, values):
                rows[c].append(x)

        at = {int(i): [(q["x"], q["y"]) for q in p] for i, p in zip(a.line_id, a.p)}
        work = []
        for r in b.sort_values(["x", "y", "node"]).itertuples():
            known = {m["id"]: (int(m["line_id"]), bool(m["is_end"]), bool(m["updatable"])) for m in r.m}
            work.append({"x": r.x, "y": r.y, "members": list(known.values()), "bridge": (known[r.id1], known[r.id2])})
        for x, y, message, ids in snap_nodes(at, work, tolerance):
            add(None, None, x, y, message, ids)
        for i, line in at.items():
            for k, (x, y) in enumerate(line, 1):
                add(i, k, x, y, None, None)
        return pd.DataFrame(rows).astype({"line_id": "Int64", "seq": "Int64"})

    out = cut(lines.groupBy("component").cogroup(nodes.groupBy("group")).applyInPandas(run, "line_id long, seq long, x double, y double, message string, ids string"))
    moved = out.where("message is null").select("line_id", "seq", "x", "y")
    rest = v.select("line_id", "seq", "x", "y").join(comp.select("line_id"), "line_id", "left_anti")
    return moved.unionByName(rest), out.where("message is not null").select("x", "y", "message", "ids")
