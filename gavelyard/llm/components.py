"""Connected components of an edge table, by rounds that each shrink it; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import keep


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition, block by block: a spanning forest of stars replaces them."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while (up := parent[x]) != top:
                parent[x], x = top, up
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of `edges` the smallest node that it reaches.

    Each round does a local union-find in every partition, then makes large stars and small stars: every node
    is tied to the smallest neighbour seen. It ends when all edges point straight at a component's smallest
    node. Self loops give their node as its own component; null ends are ignored; no edges give no rows.
    """
    tied = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = None
    current = keep(tied.mapInArrow(_forest, "u long, v long").distinct(), "cc-edges")
    loops = tied.where("u = v").select(F.col("u").alias("node")).distinct()
    for _ in range(most_rounds):
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
        current = keep(small.distinct(), "cc-edges")
        # settled: no node has two parents, and no parent has a parent
        wide = current.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        open_ends = wide.where("low != high").select("u").union(current.select(F.col("v").alias("u")).join(wide.select("u"), "u", "left_semi"))
        if open_ends.isEmpty():
            nodes = current
            break
    if nodes is None:
        raise RuntimeError("components did not settle")
    roots = nodes.select(F.col("v").alias("node")).distinct()
    loops = loops.join(nodes.select(F.col("u").alias("node")), "node", "left_anti")
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.union(loops).distinct().select("node", F.col("node").alias("component")))
