"""Exact top-k inner products by best-first search of M-trees.

Vectors are dealt into parts by a hash of their id. A part's M-tree has pages of entries: a node holds, for each
child, a routing vector, the radius that covers all vectors below it, and the distance from the node's own
routing vector. For a query q, no vector within r of c scores over q.c + |q| r; and as c lies at a stored
distance d from the parent's p, q.c itself is at most q.p + |q| d, so a child or vector whose bound falls
short is passed over before its product is computed.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealwright.llm.sizing import parts_for

PAGE, FANOUT = 256, 16


@dataclass
class Node:
    """Children with their routing vectors, radii and distances to this node's routing vector; or a page of vectors."""

    vectors: np.ndarray
    parent_distance: np.ndarray
    ids: np.ndarray | None = None
    radius: np.ndarray | None = None
    least_id: np.ndarray | None = None
    children: list = field(default_factory=list)


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def build(x: np.ndarray, ids: np.ndarray, center: np.ndarray | None = None, page: int = PAGE, fanout: int = FANOUT) -> Node:
    """Bulk-loads a tree: routing vectors are chosen far from each other, vectors go to the nearest."""
    center = x[0] if center is None else center
    if len(x) <= page:
        order = np.argsort(ids, kind="stable")
        return Node(x[order], _distance(x[order], center), ids=ids[order])
    n = min(fanout, math.ceil(len(x) / page))
    far = _distance(x, center)
    chosen, near, owner = [], np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i in range(n):
        at = int(np.argmax(far if i == 0 else near))
        if i and near[at] == 0:
            break
        chosen.append(at)
        d = _distance(x, x[at])
        owner[d < near] = i
        near = np.minimum(near, d)
    if len(chosen) == 1:  # all vectors equal: even pages
        owner = np.arange(len(x)) * n // len(x)
        chosen = [int(np.flatnonzero(owner == i)[0]) for i in range(n)]
    groups = [np.flatnonzero(owner == i) for i in range(len(chosen))]
    routing = x[chosen]
    return Node(
        routing,
        _distance(routing, center),
        radius=np.array([_distance(x[g], c).max() for g, c in zip(groups, routing)]),
        least_id=np.array([ids[g].min() for g in groups]),
        children=[build(x[g], ids[g], c, page, fanout) for g, c in zip(groups, routing)],
    )


def search(root: Node, q: np.ndarray, k: int, own_id: int | None) -> tuple[list[tuple[int, int]], int]:
    """([(score, id)] of the k best, equal scores by smaller id; how many products were computed)."""
    norm = float(np.sqrt(q @ q))
    slack = 1e-9 * (1.0 + norm) * (1.0 + norm)
    best: list[tuple[float, int]] = []  # smallest first: (score, -id)
    todo: list = [(-math.inf, 0, root, math.inf)]
    products = tie = 0
    while todo:
        bound, _, node, parent = heapq.heappop(todo)
        if len(best) == k and -bound + slack < best[0][0]:
            break
        floor = best[0][0] if len(best) == k else -math.inf
        reach = 0.0 if node.radius is None else node.radius
        maybe = parent + norm * (node.parent_distance + reach) + slack >= floor if parent < math.inf else np.ones(len(node.vectors), bool)
        at = np.flatnonzero(maybe)
        if not len(at):
            continue
        score = node.vectors[at] @ q
        products += len(at)
        if node.radius is not None:
            upper = score + norm * node.radius[at]
            for i, u, s in zip(at.tolist(), upper.tolist(), score.tolist()):
                if u + slack > floor or (u + slack >= floor and node.least_id[i] < -best[0][1]):
                    tie += 1
                    heapq.heappush(todo, (-u, tie, node.children[i], s))
            continue
        ids = node.ids[at]
        if own_id is not None:
            score, ids = score[ids != own_id], ids[ids != own_id]
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            pick = np.flatnonzero(score >= max(cut, floor))
            pick = pick[np.lexsort((ids[pick], -score[pick]))][:k]
        else:
            pick = np.flatnonzero(score >= floor)
        for s, i in zip(score[pick].tolist(), ids[pick].tolist()):
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))
    return [(int(s), -i) for s, i in sorted(best, reverse=True)], products


def _matrices(t: pa.Table):
    """(dimension, ids, float matrix) of each dimension among a table's vectors."""
    size = np.array([len(v) for v in t.column("v").to_pylist()]) if t.num_rows else np.zeros(0, int)
    ids = t.column("vec_id").to_numpy()
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]) if t.num_rows else np.zeros(0)
    begin = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), ids[rows], values[begin[rows][:, None] + np.arange(d)].astype(np.float64)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, part_bytes: int = 4 << 20, block: int = 1024) -> DataFrame:
    """The k highest integer inner products of every query with all other rows of vectors.

    Components become floor(scale * x). Rows: query_id, rank (from 1), vec_id, score; ties go to
    the smaller vec_id, and a query without k others has fewer rows. Products must stay below
    2**53, where sums of doubles are exact.

    Vectors that are null, or hold a null or non-finite component, take no part, nor do null ids;
    vectors of another length than the query's don't meet it. Repeated rows count each. Empty
    vectors score 0 with each other. An empty table gives no rows. Queries go to all parts in
    blocks of about `block`, so a task holds one part and one block.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fit = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        return df.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

    parts = max(parts_for(vectors, part_bytes), 1)
    mine = whole(queries)
    blocks = max(1, math.ceil(mine.count() / block))
    left = whole(vectors).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = mine.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if a.num_rows and b.num_rows:
            asked = {d: (ids, x) for d, ids, x in _matrices(b)}
            for d, ids, x in _matrices(a):
                if d in asked:
                    root = build(x, ids)
                    for q_id, q in zip(asked[d][0].tolist(), asked[d][1]):
                        rows += [(q_id, i, s) for s, i in search(root, q, k, q_id)[0]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], schema=schema)

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
