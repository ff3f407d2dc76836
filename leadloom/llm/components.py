"""Connected components of a graph given as edges: in rounds of joins, or in one step where there are few edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Edges that one task joins up; a larger graph goes in rounds, each of which costs several shuffles however few edges there are.
FEW = 20_000


def joined_up(batches):
    """node and root of every node of the edges in these batches, by union and find."""
    root: dict = {}

    def find(x):
        top = root.setdefault(x, x)
        while top != root[top]:
            top = root[top]
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (least node of its component) for every node that has an edge to another one.

    Nodes are longs.  ``edges`` is counted first: FEW or less are joined up by one task.
    More go in rounds of two steps.  A node's edges move to the least neighbour of their
    smaller end; then its smaller neighbours are linked to the least of them.
    Every round is written to the shared folder; paths shrink by a constant factor
    a round.
    """
    edges = edges.select(F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)).where(F.col(a) != F.col(b))
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(joined_up, "node long, root long")
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        up = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        # Both uses of the moved edges read one exchange.
        moved = now.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).repartition("u")
        low = moved.groupBy("u").agg(F.min("v").alias("m"))
        small = moved.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Each node has one edge by now, to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
