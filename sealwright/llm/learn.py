"""Shared parts of the trained operators: bounded labelled samples and logistic fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (whole) and y (0 or 1) of at most `most` labelled ids, the same ones at any partitioning.

    keep: a condition on column doc_id; rows that fail it are never chosen. The ids are chosen
    first, those of smallest hash. Ids that several label rows name count once if the rows
    agree, and not at all otherwise. Rows of docs that share an id are all given.
    """
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(keep & F.col("y").isin(0, 1))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2 AND doc_id IS NOT NULL").drop("y2")
    # the bound makes the broadcast safe
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def sigmoid(z: np.ndarray) -> np.ndarray:
    """The logistic function; beyond 35 it is as at 35."""
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x holds its own constant column if one is wanted."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
