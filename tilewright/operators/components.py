"""Connected components of an edge table, by contraction within tasks and pointer jumping between them.

Every edge points from its larger node to its smaller one.  A task contracts the edges it has to stars; with all
edges of a node in one task, that node gets one edge there, its own.  Each round then lets an edge's smaller end
take that end's own edge, and contracts anew.  It is one join, one shuffle by the larger node and one written
table, so no lineage grows and a lost executor costs its tasks alone; chains shorten by half with each round.

A node is the larger end of at most one edge for each task that wrote the table, so no node is hot in the shuffle.
In the join a component's centre can be; its own edge is one row, both sides come straight from a shuffle, and
Spark splits the other side's rows over tasks as it runs (adaptive skew joins).  The plan is the same at every
size.  Null ends and loops are ignored; repeated edges do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources.scratch import stage

#: Nodes that a task holds at a time.
HELD = 1_000_000
EDGES = "a long, b long, own boolean, busy boolean"


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, moved), a > b, a node's edges one after the other -> stars around the smallest node of each
    component among them: (a, b, own, busy).  ``own``: a was the larger end of an edge, which no other task's a
    was.  ``busy``: not all was settled, as an edge had moved or a node had edges to several."""
    up: dict[int, int] = {}
    owners: set[int] = set()
    busy, last = False, (None, None)

    def find(x: int) -> int:
        root = x
        while (to := up.setdefault(root, root)) != root:
            root = to
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        own = [x in owners for x, _ in pairs]
        up.clear()
        owners.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(own, pa.bool_()), pa.array([busy] * len(pairs), pa.bool_())], ["a", "b", "own", "busy"])

    for batch in batches:
        for a, b, moved in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "moved"))):
            if a != last[0] and len(up) > HELD:
                yield stars()
                busy = False
            busy = busy or moved or a == last[0] and b != last[1]
            last = a, b
            owners.add(a)
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield stars()


def _met(edges: DataFrame) -> DataFrame:
    """Contracted edges, with all edges of a larger node in one task."""
    return stage(edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_contracted, EDGES), "edges")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): each node that has an edge, with the smallest node it can reach."""
    ends = edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    down = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("moved"))
    now = _met(down.mapInArrow(_contracted, EDGES).select("a", "b", F.lit(True).alias("moved")))
    while now.agg(F.bool_or("busy")).head()[0]:
        own = now.filter("own").select(F.col("a").alias("node"), F.col("b").alias("to"))
        # an edge that is no node's own has given no pointer yet
        now = _met(now.join(own.hint("merge"), F.col("b") == F.col("node"), "left").select("a", F.coalesce("to", "b").alias("b"), (F.col("to").isNotNull() | ~F.col("own")).alias("moved")))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())
