"""Points under intervals, where intervals may overlap and claim anything.

Nothing is spelled out point by point: intervals become disjoint pieces in one sweep over their ends, then pieces and points stream by in
one order and the last piece is carried on. Points are dealt by key and chunk of positions, so one key may hold most of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS, BIN_BITS = 16, 10


def first_owners(intervals: DataFrame, key: str, low: str, high: str, owner: str) -> DataFrame:
    """(key, low, high, owner): disjoint pieces, each with the smallest owner among the intervals over it.

    Both ends belong to an interval; empty ones and those with nulls have no part. A key's intervals stream through one sorted
    partition; the task holds those that are open at a point. There are at most twice as many pieces as intervals.
    """
    kinds = dict(intervals.dtypes)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, heap, pending = object(), 0, [], None
        rows: list[tuple] = []

        def emit(a: int, b: int, who) -> None:
            nonlocal pending
            if pending and pending[0] == current and pending[3] == who and pending[2] == a - 1:
                pending = (current, pending[1], b, who)
                return
            if pending:
                rows.append(pending)
            pending = (current, a, b, who)

        def drain(until: int | None) -> None:
            """Pieces before `until`, or all that are left."""
            nonlocal at
            while heap and (until is None or at < until):
                who, last = heap[0]
                if last < at:
                    heapq.heappop(heap)
                    continue
                end = last if until is None else min(last, until - 1)
                emit(at, end, who)
                at = end + 1
            at = at if until is None else until

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "low", "high", "owner"])
            rows.clear()
            return out

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), batch.schema.field(3).type]
            for name, a, b, who in zip(*(c.to_pylist() for c in batch.columns)):
                if name != current:
                    drain(None)
                    heap.clear()
                    if pending:
                        rows.append(pending)
                    current, at, pending = name, a, None
                drain(a)
                heapq.heappush(heap, (who, b))
            yield batch_of()
        drain(None)
        if pending:
            rows.append(pending)
        yield batch_of()

    narrow = intervals.select(F.col(key).alias("key"), F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high"), F.col(owner).alias("owner")).where("key IS NOT NULL AND low <= high AND owner IS NOT NULL")
    out = narrow.repartition("key").sortWithinPartitions("key", "low", "owner").mapInArrow(sweep, f"key {kinds[key]}, low long, high long, owner {kinds[owner]}")
    return out.select(F.col("key").alias(key), F.col("low").alias(low), F.col("high").alias(high), F.col("owner").alias(owner))


def carried(points: DataFrame, pieces: DataFrame, key: str, point: str, low: str, high: str, owner: str, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Points with the owner of the piece over them; points under none are left out. Pieces of a key must be disjoint.

    One shuffle, by key and chunk of 2^chunk_bits positions; a piece goes to the chunks it touches.
    """
    chunk = lambda c: F.call_function("shiftright", c, F.lit(chunk_bits))
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(pieces.dtypes)
    row = F.struct(*points.columns)
    dots = points.select(F.col(key).alias("k__"), F.col(point).cast("long").alias("at__"), F.lit(1).alias("side__"), null("long").alias("end__"), null(kinds[owner]).alias("own__"), row.alias("row__")).withColumn("chunk__", chunk(F.col("at__")))
    spread = pieces.withColumn("chunk__", F.explode(F.sequence(chunk(F.col(low)), chunk(F.col(high)))))
    starts = spread.select(F.col(key).alias("k__"), F.greatest(F.col(low), F.call_function("shiftleft", F.col("chunk__"), F.lit(chunk_bits))).alias("at__"), F.lit(0).alias("side__"), F.col(high).alias("end__"), F.col(owner).alias("own__"), null(points.select(row.alias("r")).schema["r"].dataType).alias("row__"), "chunk__")
    w = Window.partitionBy("k__", "chunk__").orderBy("at__", "side__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.when(F.col("side__") == 0, F.struct("end__", "own__"))
    met = dots.unionByName(starts).withColumn("piece__", F.last(piece, ignorenulls=True).over(w))
    return met.where("side__ = 1 AND at__ <= piece__.end__").select("row__.*", F.col("piece__.own__").alias(owner))


def binned(points: DataFrame, intervals: DataFrame, key: str, point: str, low: str, high: str, bin_bits: int = BIN_BITS) -> DataFrame:
    """Points with every interval over them, as an equi-join on bins of 2^bin_bits positions: intervals name their bins, not their points."""
    bins = intervals.withColumn("bin__", F.explode(F.sequence(F.call_function("shiftright", F.col(low), F.lit(bin_bits)), F.call_function("shiftright", F.col(high), F.lit(bin_bits)))))
    dots = points.withColumn("bin__", F.call_function("shiftright", F.col(point).cast("long"), F.lit(bin_bits)))
    return dots.join(bins, [key, "bin__"]).where(F.col(point).between(F.col(low), F.col(high))).drop("bin__")
