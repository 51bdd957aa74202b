"""A table function: the inclusion path of every leaf of a tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

ADDED = [T.StructField("leaf_index", T.LongType()), T.StructField("tree_size", T.LongType()), T.StructField("audit_path", T.ArrayType(T.StringType()))]


@udtf
class AuditPath:
    """audit_path(TABLE(t) PARTITION BY (tree, ...) ORDER BY position): one row for each leaf.

    t has a binary column `leaf`; its other columns come back as they are, followed by leaf_index, tree_size and audit_path (hex, from
    the leaf's sibling up; levels without a sibling are left out). A partition is a tree, so it has to fit a task: operators.merkle.deep_proofs is for
    larger ones. A null leaf is an error.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("audit_path takes a table")
        fields = rows.dataType.fields
        if not any(f.name == "leaf" and isinstance(f.dataType, T.BinaryType) for f in fields):
            raise ValueError("audit_path needs a binary column: leaf")
        if taken := {f.name for f in fields} & {f.name for f in ADDED}:
            raise ValueError(f"audit_path adds columns of its own: {sorted(taken)}")
        return AnalyzeResult(T.StructType([f for f in fields if f.name != "leaf"] + ADDED))

    def __init__(self):
        self.leaves, self.rest = [], []

    def eval(self, rows: Row) -> None:
        if rows["leaf"] is None:
            raise ValueError(f"a leaf is null: {rows}")
        self.leaves.append(bytes(rows["leaf"]))
        self.rest.append([v for n, v in zip(rows.__fields__, rows) if n != "leaf"])

    def terminate(self) -> Iterator[tuple]:
        below, level = [], self.leaves
        while len(level) > 1:
            below.append([x.hex() for x in level])
            up = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
            level = up + level[2 * len(up) :]
        for i, own in enumerate(self.rest):
            path = [nodes[i >> k ^ 1] for k, nodes in enumerate(below) if i >> k ^ 1 < len(nodes)]
            yield (*own, i, len(self.leaves), path)
