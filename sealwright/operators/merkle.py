"""Merkle trees over ordered leaves: roots, inclusion proofs, and their verification.

A tree's left part is the largest power of two below its size, which is the same as pairing
neighbours level by level and carrying an odd last node up unchanged. A segment's tree is computed
inside one array, as many levels as its leaves need; `deep_roots` and `deep_proofs` work on trees that no one task should hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.functions.hashing import EMPTY_ROOT, node_hash, to_hex
from sealwright.shared import kept


def _steps(n: Column) -> Column:
    """One entry for each level above n leaves: as many as n - 1 has binary digits."""
    return F.sequence(F.lit(1), F.length(F.bin(n.cast("long") - 1)))


def _next_level(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), ((F.size(nodes) + 1) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(nodes), node_hash(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))).otherwise(F.get(nodes, 2 * i)))


def levels(leaves: Column) -> Column:
    """All levels of a tree, from the leaves to the root."""
    grow = lambda acc, _: F.when(F.size(F.element_at(acc, -1)) > 1, F.concat(acc, F.array(_next_level(F.element_at(acc, -1))))).otherwise(acc)
    return F.aggregate(_steps(F.size(leaves)), F.array(leaves), grow)


def ordered(leaf: Column, order: Column) -> Column:
    """Aggregate: a group's leaves in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), leaf.alias("l")))), lambda x: x["l"])


def root(leaves: Column) -> Column:
    """The root's bytes; no leaves give the hash of nothing."""
    return F.when(F.size(leaves) == 0, F.unhex(F.lit(EMPTY_ROOT))).otherwise(F.get(F.element_at(levels(leaves), -1), F.lit(0)))


def roots(leaves: DataFrame, keys: list[str], order: str, leaf: str = "leaf") -> DataFrame:
    """(keys, n, merkle_root in hex) of trees whose leaves fit one task; see deep_roots for others."""
    grouped = leaves.groupBy(*keys).agg(ordered(F.col(leaf), F.col(order)).alias("leaves"))
    return grouped.select(*keys, F.size("leaves").cast("long").alias("n"), to_hex(root(F.col("leaves"))).alias("merkle_root"))


def deep_roots(leaves: DataFrame, keys: list[str], index: str, leaf: str = "leaf") -> DataFrame:
    """As roots, for trees of any size; index: a leaf's position from 0. One shuffle for each level."""
    sizes = leaves.groupBy(*keys).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    now = leaves.select(*keys, F.col(index).cast("long").alias("i"), F.col(leaf).alias("h"))
    while most > 1:
        parent = F.floor(F.col("i") / 2).alias("i")
        met = now.groupBy(*keys, parent).agg(F.min_by("h", now["i"]).alias("left"), F.max_by("h", now["i"]).alias("right"), F.count("*").alias("c"))
        now = met.select(*keys, "i", F.when(F.col("c") == 2, node_hash(F.col("left"), F.col("right"))).otherwise(F.col("left")).alias("h"))
        most = (most + 1) // 2
    return now.join(sizes, keys).select(*keys, "n", to_hex(F.col("h")).alias("merkle_root"))


def audit_path(all_levels: Column, index: Column) -> Column:
    """Hex hashes of the siblings from the leaf at index to the root; levels without one are left out."""
    below = F.slice(all_levels, F.lit(1), F.size(all_levels) - 1)
    siblings = F.transform(below, lambda nodes, k: F.get(nodes, F.call_function("shiftright", index.cast("int"), k).bitwiseXOR(F.lit(1))))
    return F.transform(F.filter(siblings, lambda h: h.isNotNull()), to_hex)


def verify_path(leaf: Column, index: Column, size: Column, path: Column, root_hex: Column) -> Column:
    """Whether the path leads from the leaf to the root; false for an index outside the tree and for a path too short or too long."""
    start = F.struct(leaf.alias("h"), index.cast("long").alias("i"), size.cast("long").alias("n"), F.lit(0).alias("used"))

    def step(acc: Column, _: Column) -> Column:
        i, n, used = acc["i"], acc["n"], acc["used"]
        paired = (i % 2 == 1) | (i + 1 < n)
        other = F.unhex(F.get(path, used))
        h = F.when((n > 1) & paired, F.when(i % 2 == 1, node_hash(other, acc["h"])).otherwise(node_hash(acc["h"], other))).otherwise(acc["h"])
        return F.struct(h.alias("h"), F.when(n > 1, F.floor(i / 2)).otherwise(i).cast("long").alias("i"), F.when(n > 1, F.floor((n + 1) / 2)).otherwise(n).cast("long").alias("n"), F.when((n > 1) & paired, used + 1).otherwise(used).alias("used"))

    end = F.aggregate(_steps(size), start, step)
    good = (index >= 0) & (index < size) & (end["used"] == F.size(path)) & (to_hex(end["h"]) == root_hex)
    return F.coalesce(good, F.lit(False))


_BLOCK_LEVELS = 9  # levels that are built at once: 512 nodes a block


def _blocks(nodes: DataFrame, keys: list[str], levels_: int) -> DataFrame:
    """Nodes (keys, i, h) as rows (keys, b, nodes): 2^levels_ neighbours in order. A block's tree is that part of the whole tree, as its start is even at all of its levels."""
    return nodes.groupBy(*keys, F.call_function("shiftright", F.col("i"), F.lit(levels_)).alias("b")).agg(ordered(F.col("h"), F.col("i")).alias("nodes"))


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), where value is computed once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def deep_proofs(leaves: DataFrame, keys: list[str], index: str, leaf: str = "leaf", levels_at_once: int = _BLOCK_LEVELS) -> DataFrame:
    """(keys, leaf_index, leaf, tree_size, merkle_root, audit_path, verified) of every leaf, for trees of any size.

    index: a leaf's position from 0, without gaps. Trees are cut into blocks of 2^levels_at_once neighbours, the blocks' roots into
    blocks again, and so on: one shuffle for so many levels, over so many times fewer rows each. Paths then come down: a
    block takes the path of its root, its members put their own siblings before it. Leaves move once up and never down; no array
    is longer than a block or a path. Each level of blocks is kept in the shared folder. verified: whether the path
    leads to merkle_root. Null leaves are an error of the caller's; an empty table gives no rows.
    """
    rows = leaves.select(*keys, F.col(index).cast("long").alias("i"), F.col(leaf).alias("h"))
    sizes = kept(rows.groupBy(*keys).agg(F.count("*").alias("tree_size")), "tree-sizes")
    most = sizes.agg(F.max("tree_size")).first()[0] or 0
    stages = []
    while True:
        blocks = kept(_blocks(rows, keys, levels_at_once), "tree-blocks")
        stages.append(blocks)
        most = -(-most // (1 << levels_at_once))
        if most <= 1:
            break
        rows = blocks.select(*keys, F.col("b").alias("i"), root(F.col("nodes")).alias("h"))
    above = stages[-1].select(*keys, F.col("b").alias("i"), F.array().cast("array<string>").alias("path"), to_hex(root(F.col("nodes"))).alias("merkle_root"))
    for blocks in reversed(stages):
        held = blocks.join(above.withColumnRenamed("i", "b"), [*keys, "b"])
        first = F.call_function("shiftleft", F.col("b"), F.lit(levels_at_once))
        inside = lambda tree: F.transform("nodes", lambda h, j: F.struct((first + j).alias("i"), h.alias("h"), F.concat(audit_path(tree, j), F.col("path")).alias("path")))
        out = held.select(*keys, "merkle_root", F.explode(_bound(levels(F.col("nodes")), inside)).alias("x"))
        above = out.select(*keys, "x.i", "x.h", "x.path", "merkle_root")
        if blocks is not stages[0]:
            above = kept(above.drop("h"), "tree-paths")
    done = above.join(sizes, keys).select(*keys, F.col("i").alias("leaf_index"), F.col("h").alias("leaf"), "tree_size", "merkle_root", F.col("path").alias("audit_path"))
    return done.withColumn("verified", verify_path(F.col("leaf"), F.col("leaf_index"), F.col("tree_size"), F.col("audit_path"), F.col("merkle_root")))
