"""Hash chains of entries: building, verifying, and the heads they end in.

A chain is sequential, so one log's links are folded in one task, over rows that carry digests
only; many logs fold side by side. Verification needs no order between rows: each entry meets the
one before it by an equi-join on its position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.config import AUDIT_GENESIS
from sealwright.functions.hashing import CHAIN_FIELDS, chain_digest

_LINK = [*CHAIN_FIELDS, "seq", "timestamp"]


def allocate(df: DataFrame, log: str, order: list[str], base: int = 0) -> DataFrame:
    """Adds seq: the position of a row in its log from base on, in the given order."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(log).orderBy(*order)) - 1 + base).cast("long"))


def build_chain(entries: DataFrame, log: str = "log_id", genesis: str = AUDIT_GENESIS, heads: DataFrame | None = None) -> DataFrame:
    """Adds prev_hash and chain_hash to entries, log by log in order of seq.

    heads: (log, chain_hash) of logs to be continued; others start from genesis. A log's rows
    stream through one sorted partition, so memory doesn't grow with the log. Fields must not be null.
    """
    return _fold(entries, log, ["seq"], genesis, None if heads is None else heads.select(log, F.col("chain_hash").alias("start__"), F.lit(0).cast("long").alias("first__")), number=False)


def append_chain(rows: DataFrame, order: list[str], log: str = "log_id", genesis: str = AUDIT_GENESIS, heads: DataFrame | None = None) -> DataFrame:
    """Numbers and chains rows in one go, each log in the given order: adds seq, prev_hash and chain_hash with a single shuffle.

    heads: (log, next_seq, chain_hash) of logs to be continued. Rows that tie in the order come in any order, so it should be total.
    """
    return _fold(rows, log, order, genesis, None if heads is None else heads.select(log, F.col("chain_hash").alias("start__"), F.col("next_seq").alias("first__")), number=True)


def _fold(rows: DataFrame, log: str, order: list[str], genesis: str, starts: DataFrame | None, number: bool) -> DataFrame:
    """Whole rows stream through, so nothing is joined back: Arrow hands the other columns on as they are."""
    if starts is None:
        start = rows.withColumn("start__", F.lit(genesis)).withColumn("first__", F.lit(0).cast("long"))
    else:
        start = rows.join(starts, log, "left").withColumn("start__", F.coalesce("start__", F.lit(genesis))).withColumn("first__", F.coalesce("first__", F.lit(0).cast("long")))
    names = [c for c in start.columns if c not in ("start__", "first__")]
    fields = [*CHAIN_FIELDS, *([] if number else ["seq"]), "timestamp"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head, at = object(), "", 0
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            seqs, prev, mine = [], [], []
            for log_id, begin, first, *parts in zip(*(column(n).to_pylist() for n in (log, "start__", "first__", *fields))):
                if log_id != current:
                    current, head, at = log_id, begin, first
                if number:
                    parts.insert(-1, at)
                if None in parts:
                    raise ValueError(f"entry {parts[-2]} of log {log_id} has a null field")
                seqs.append(parts[-2])
                prev.append(head)
                head = hashlib.sha256("|".join([head, *map(str, parts)]).encode()).hexdigest()
                mine.append(head)
                at += 1
            added = [pa.array(prev, pa.string()), pa.array(mine, pa.string())] + ([pa.array(seqs, pa.int64())] if number else [])
            yield pa.RecordBatch.from_arrays([*(column(n) for n in names), *added], [*names, "prev_hash", "chain_hash", *(["seq"] if number else [])])

    schema = T.StructType([start.schema[n] for n in names] + [T.StructField(n, T.StringType()) for n in ("prev_hash", "chain_hash")] + ([T.StructField("seq", T.LongType())] if number else []))
    done = start.repartition(log).sortWithinPartitions(log, *order).mapInArrow(fold, schema)
    rest = [c for c in names if c not in (log, *_LINK)]
    return done.select(log, *_LINK, *rest, "prev_hash", "chain_hash")


def verify_chain(entries: DataFrame, log: str = "log_id", pos: str = "pos", genesis: str = AUDIT_GENESIS) -> DataFrame:
    """(log, pos, status, expected, found) of every entry; pos counts a log's entries from 0.

    status: OK, PREV_BREAK (prev_hash isn't the chain_hash before it) or HASH_BREAK (the entry's
    fields don't give its chain_hash; expected is the stored value).
    """
    before = entries.select(F.col(log), (F.col(pos) + 1).alias(pos), F.col("chain_hash").alias("before"))
    both = entries.join(before, [log, pos], "left").withColumn("want", F.when(F.col(pos) == 0, F.lit(genesis)).otherwise(F.col("before")))
    own = chain_digest(F.col("prev_hash"))
    status = F.when(~F.col("prev_hash").eqNullSafe(F.col("want")), "PREV_BREAK").when(~own.eqNullSafe(F.col("chain_hash")), "HASH_BREAK").otherwise("OK")
    out = both.withColumn("status", status)
    expected = F.when(F.col("status") == "PREV_BREAK", F.col("want")).when(F.col("status") == "HASH_BREAK", F.col("chain_hash"))
    found = F.when(F.col("status") == "PREV_BREAK", F.col("prev_hash")).when(F.col("status") == "HASH_BREAK", own)
    return out.select(log, pos, "status", expected.alias("expected"), found.alias("found"))


def first_breaks(verified: DataFrame, log: str = "log_id", pos: str = "pos") -> DataFrame:
    """The first break of each log that has one."""
    bad = verified.where("status <> 'OK'")
    return bad.groupBy(log).agg(F.min_by(F.struct(pos, "status", "expected", "found"), pos).alias("b")).select(log, "b.*")


def heads(entries: DataFrame, log: str = "log_id", pos: str = "pos") -> DataFrame:
    """(log, next_seq, chain_hash): where each log goes on."""
    return entries.groupBy(log).agg((F.max_by("seq", pos) + 1).alias("next_seq"), F.max_by("chain_hash", pos).alias("chain_hash"))


def sequence_gaps(entries: DataFrame, log: str = "log_id", pos: str = "pos") -> DataFrame:
    """Entries whose seq isn't their position: chains alone don't show them."""
    return entries.where(F.col("seq") != F.col(pos)).select(log, pos, "seq")
