"""Connected components by alternating large-star and small-star steps, each a groupBy-min and a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.llm.kernel import cut

#: a node of more edges is a hub
HUB = 50_000
#: edges that a task writes
EACH = 50_000


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges at once; of two roots the smaller stays one."""
    pairs = [np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]) for batch in batches if batch.num_rows]
    if not pairs:
        return
    nodes, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in at.reshape(2, -1).T.tolist():
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[top(x) for x in range(len(nodes))]])], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has one.

    Edges that are loops or hold nulls count for nothing; an empty table gives an empty result. While there is a hub, the
    pre-aggregated minima are checkpointed before they are joined back: the join then stands in a stage of its own, where adaptive
    execution splits the hub. A round's edges are written by as many tasks as they need, not by one for each shuffle
    partition, so that few edges leave few files. Rounds grow with the logarithm of the longest path. Up to ``few`` edges are
    settled by one task, without rounds.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if few and edges.count() <= few:
        return cut(edges.coalesce(1).mapInArrow(_settled, "node long, component long"))
    before = None
    size, hub = (x or 0 for x in edges.groupBy("v").count().agg(F.sum("count"), F.max("count")).first())
    tasks = lambda n: max(8, n // EACH)
    edges = cut(edges.coalesce(tasks(size)))
    for _ in range(max_rounds):
        apart = cut if hub > HUB else (lambda df: df)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = apart(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        small = large.join(apart(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct().coalesce(tasks(2 * size)))
        # a node's edges lie with its larger or its smaller neighbours: the sum bounds both
        each = edges.select(F.explode(F.array("u", "v")).alias("x"), F.xxhash64("u", "v").alias("h")).groupBy("x").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
        *now, hub = each.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        size, hub = (now[0] or 0) // 2, hub or 0
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
