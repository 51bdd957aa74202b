"""Connected components of a large graph: forests made inside tasks, then alternating steps towards smaller neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealwright.llm.hot import hot_keys, join_hot
from sealwright.llm.scratch import kept

PIECE = 1 << 17  # edges that a task joins at once (2 MB)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that isn't the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _forests(edges: DataFrame, piece: int) -> DataFrame:
    """Edges (u, v) with the same components: each task's, `piece` of them at a time, become forests of stars. So
    a node is the larger end of one edge at most of each piece, whatever it was before."""

    def join(held):
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(t.column(0).to_numpy(), t.column(1).to_numpy())], ["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, piece):
                part = batch.slice(a, piece)
                if n + part.num_rows > piece:
                    yield join(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield join(held)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node has one edge, to a node that has no smaller neighbour itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return not nodes.where("ups > 1 OR (ups = 1 AND least = 0)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 60, piece: int = PIECE) -> DataFrame:
    """(node, component) of every node of edges (columns a, b): component is the smallest node reachable.

    Tasks make forests of the edges they hold; the edges left are at most one for each node and piece. Each round then joins
    all smaller neighbours of a node to the smallest (a window over the node, which has few), and moves every edge's smaller end to that
    end's own smallest neighbour (a join, in which nodes of many edges are salted). The number of edges never grows. Rounds end when all
    edges lead to their component's smallest node, or when no more than `piece` edges are left, which one task ends; they
    number about the logarithm of a component's size. No edges, no rows; an edge from a node to itself gives the node its own component.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = kept(_forests(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), piece), "edges")
    for _ in range(most_rounds):
        rows = now.count()
        if rows <= piece:
            now = kept(_forests(now.coalesce(1), piece), "edges")
            break
        if _settled(now):
            break
        met = _forests(now, piece).withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = kept(met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), "edges")
        low = small.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        hot = hot_keys(small.groupBy("v").agg(F.count("*").alias("n")), "v", total=rows)
        now = kept(join_hot(small, low, "v", "u", hot, "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
