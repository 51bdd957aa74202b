"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwright.llm.textbuf import buffers, pieces

SAMPLE_DOCS, HOT_DOCS = 1 << 15, 1 << 17


def hot_hashes(texts: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], docs: int = HOT_DOCS) -> np.ndarray:
    """Hashes that stand in more than `docs` documents (id__, text__), as a sample of about SAMPLE_DOCS of them tells; in ascending order.

    hashes: (text index, hash) of all that a piece of texts holds. The result decides only how work is dealt, and is the same
    at any partitioning. A hash counts if it stands in over 16 of the sample's documents, so there are at most a 16th of the sample's.
    """
    step = max(1, texts.count() // SAMPLE_DOCS)

    def count(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            once = []  # of each text, every hash once
            for a, b in pieces(off, 2 << 20):
                doc, h = hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                once.append(h[new])
            value, times = np.unique(np.concatenate(once) if once else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times, pa.int64())], ["h", "n"]).filter(pa.array(times > 1))

    sample = texts.where(F.pmod(F.xxhash64("id__"), F.lit(step)) == 0).select("text__").repartition(4)
    found = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > max(16, docs // step))
    return np.sort(found.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def hot_keys(counts: DataFrame, key: str, count: str = "n", share: int = 200, least: int = 300, total: int | None = None) -> list:
    """Keys with more than 1/share of all rows (and at least `least`): never more than `share` of them. total: about all rows, if known."""
    if total is None:
        total = counts.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count) > max(least, total // share)).select(key).collect()]


def join_hot(rows: DataFrame, small: DataFrame, key: str, spread: str, hot: list, how: str = "inner", salts: int = 64) -> DataFrame:
    """Joins rows with `small` (one row for each key); only the keys in hot are dealt over `salts` tasks."""
    if not hot:
        return rows.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("salt_", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    right = small.withColumn("salt_", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "salt_"], how).drop("salt_")
