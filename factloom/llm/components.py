"""Connected components of an undirected edge table: local ones in each task, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, trimmed, written


#: Edges that a task makes into stars at once.
LOCAL_EDGES = 1 << 18


def local_stars(table: pa.Table) -> pa.RecordBatch:
    """Edges (u, v) that put each node of the given ones, but the least of its component among them, under that one."""
    u, v = (table.column(c).combine_chunks() for c in ("u", "v"))
    nodes = pc.unique(pa.chunked_array([u, v]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(x, nodes).to_numpy(zero_copy_only=False).astype(np.int64) for x in (u, v))
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        live = x != y
        if not live.any():
            break
        np.minimum.at(root, np.maximum(x, y)[live], np.minimum(x, y)[live])
        while (root[root] != root).any():
            root = root[root]
    under = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(under)), nodes.take(pa.array(root[under]))], ["u", "v"])


def contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The stars of as many parts of edges (a written table) as LOCAL_EDGES allows, and whether that was one part only."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= LOCAL_EDGES:
                yield local_stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield local_stars(pa.Table.from_batches(held))

    n = edges.count()
    parts = -(-n // LOCAL_EDGES)
    kind = edges.schema["u"].dataType.simpleString()
    return written(edges.coalesce(max(1, parts)).mapInArrow(trimmed(run), f"u {kind}, v {kind}"), "stars"), parts <= 1 and n < LOCAL_EDGES


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) of every node of edges (a, b).

    Tasks first make stars of the edges they hold, about LOCAL_EDGES each; where that is one part, it is done, else
    stars alternate with rounds that regroup edges under smaller nodes, so the table never grows beyond two edges a
    given one. It is written after each round: a lost executor costs one round at most. What a node's
    neighbours are grouped by is written, too, and joined back as a table of its own: broadcast while it is small, else
    both sides are shuffled and Spark can split a hub. Loops and repeated edges do no harm; edges with a null end
    are dropped.
    """
    now = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now, done = contracted(now)
    while not done:
        # Large star: each node's greater neighbours go under its least neighbour (or itself, which changes nothing).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").withColumnRenamed("u", "v"), "least")
        large = written(now.join(maybe_broadcast(least), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large-star")
        # Small star: each node's smaller neighbours and the node go under the least of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(maybe_broadcast(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        new = written(small, "edges")
        if new.count() == now.count() and new.exceptAll(now).isEmpty():
            break
        now, done = contracted(new)
        if not done:
            now = written(now.distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
