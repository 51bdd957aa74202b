"""Segments: contiguous slices of a log, sealed by a Merkle root and chained manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealwright.config import SEGMENT_GENESIS
from sealwright.functions.hashing import EMPTY_ROOT, entry_leaf, segment_digest, to_hex
from sealwright.model import MANIFEST, PROOF_SCHEMA, SEGMENT_SCHEMA
from sealwright.operators.merkle import audit_path, levels, ordered, root, verify_path
from sealwright.operators.sweep import binned, carried, first_owners


def sealed_so_far(found: DataFrame, log: str = "log_id") -> DataFrame:
    """(log, sealed_to, last_id, last_root, last_chain): where each log's manifests end."""
    by = lambda c: F.max_by(c, "segment_id")
    return found.groupBy(log).agg(F.max("last_seq").alias("sealed_to"), F.max("segment_id").alias("last_id"), by("merkle_root").alias("last_root"), by("segment_chain_hash").alias("last_chain"))


def summaries(entries: DataFrame, size: int, log: str = "log_id", after: DataFrame | None = None) -> DataFrame:
    """One row per log and segment of `size` entries: range, count, root and head. after: rows of sealed_so_far, where segments go on."""
    seq, base = F.col("seq"), F.lit(0)
    if after is not None:
        entries = entries.join(after, log, "left").where("sealed_to IS NULL OR seq > sealed_to")
        seq, base = seq - F.coalesce(F.col("sealed_to") + 1, F.lit(0)), F.coalesce("last_id", F.lit(0))
    cut = entries.withColumn("segment_id", (base + F.floor(seq / size) + 1).cast("long"))
    grouped = cut.groupBy(log, "segment_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("entry_count"), F.max_by("chain_hash", "seq").alias("head_chain_hash_at_close"), ordered(entry_leaf(F.col("chain_hash")), F.col("seq")).alias("leaves")
    )
    return grouped.withColumn("merkle_root", to_hex(root(F.col("leaves")))).drop("leaves")


def manifests(entries: DataFrame, size: int, sealed_at: str, log: str = "log_id", genesis: str = SEGMENT_GENESIS, keep_open: bool = False, after: DataFrame | None = None, schema: str = SEGMENT_SCHEMA) -> DataFrame:
    """Seals logs into chained manifests. keep_open: the last segment stays open unless it is full.

    after: manifests sealed before. Sealing goes on where they end, from the log and the manifests alone: this
    takes up the work of a sealer that was lost, and seals what a stopped one left open. A tail over `size` becomes several
    segments here; streaming.sealing.seal_stream closes it as one, as a sealer that starts up does.
    """
    before = None if after is None else sealed_so_far(after, log)
    found = summaries(entries, size, log, before)
    if keep_open:
        found = found.where(F.col("entry_count") >= size)
    empty = F.lit(EMPTY_ROOT)
    found = found.withColumn("prev_merkle_root", F.lag("merkle_root", 1).over(Window.partitionBy(log).orderBy("segment_id")))
    first = (F.lit(None).cast("string"), F.lit(genesis))
    if before is not None:
        found = found.join(before.select(log, "last_root", "last_chain"), log, "left")
        first = (F.col("last_root"), F.coalesce("last_chain", F.lit(genesis)))
    found = found.withColumn("prev_merkle_root", F.coalesce("prev_merkle_root", first[0], empty)).withColumn("sealed_at", F.lit(sealed_at)).withColumn("start", first[1])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head = object(), ""
        for batch in batches:
            prev, mine = [], []
            for log_id, _, first, last, merkle, at, begin in zip(*(c.to_pylist() for c in batch.columns)):
                if log_id != current:
                    current, head = log_id, begin
                prev.append(head)
                head = hashlib.sha256("|".join([head, merkle, str(first), str(last), at]).encode()).hexdigest()
                mine.append(head)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prev, pa.string()), pa.array(mine, pa.string())], ["log__", "segment_id", "prev_segment_chain_hash", "segment_chain_hash"])

    kind = dict(entries.dtypes)[log]
    narrow = found.select(F.col(log).alias("log__"), "segment_id", "first_seq", "last_seq", "merkle_root", "sealed_at", "start")
    links = narrow.repartition("log__").sortWithinPartitions("log__", "segment_id").mapInArrow(link, f"log__ {kind}, segment_id long, prev_segment_chain_hash string, segment_chain_hash string")
    both = found.join(links.withColumnRenamed("log__", log), [log, "segment_id"])
    return both.withColumn("schema", F.lit(schema)).withColumn("tst_path", F.lit(None).cast("string")).select(log, *[f.name for f in MANIFEST])


def verify_segment_chain(found: DataFrame, log: str = "log_id", genesis: str = SEGMENT_GENESIS, schema: str = SEGMENT_SCHEMA) -> DataFrame:
    """(log, segment_id, status): schema, then id, then previous chain hash, previous root, and the manifest's own hash.

    schema: the format's name in the logs at hand.
    """
    w = Window.partitionBy(log).orderBy("segment_id")
    d = found.withColumn("before_id", F.coalesce(F.lag("segment_id").over(w), F.lit(0))).withColumn("before_chain", F.coalesce(F.lag("segment_chain_hash").over(w), F.lit(genesis)))
    d = d.withColumn("before_root", F.coalesce(F.lag("merkle_root").over(w), F.lit(EMPTY_ROOT)))
    own = segment_digest(F.col("prev_segment_chain_hash"), F.col("merkle_root"), F.col("first_seq"), F.col("last_seq"), F.col("sealed_at"))
    status = (
        F.when(~F.col("schema").eqNullSafe(F.lit(schema)), "BAD_SCHEMA")
        .when(F.col("segment_id") != F.col("before_id") + 1, "ID_GAP")
        .when(~F.col("prev_segment_chain_hash").eqNullSafe(F.col("before_chain")), "PREV_CHAIN_BREAK")
        .when(~F.col("prev_merkle_root").eqNullSafe(F.col("before_root")), "PREV_ROOT_BREAK")
        .when(~own.eqNullSafe(F.col("segment_chain_hash")), "SELF_HASH_MISMATCH")
        .otherwise("OK")
    )
    return d.select(log, "segment_id", status.alias("status"))


def verify_against_log(found: DataFrame, entries: DataFrame, log: str = "log_id", pos: str = "pos") -> DataFrame:
    """(log, segment_id, status) of manifests against the log's slice first_seq to last_seq: range, then count, root and head.

    pos counts a log's entries from 0, so a range tells its count. Only manifests whose range and count are right meet their
    slice, by an equi-join on bins of positions; ranges may overlap.
    """
    sizes = entries.groupBy(log).agg(F.count("*").alias("log_size"))
    d = found.join(sizes, log, "left").withColumn("in_range", (F.col("first_seq") <= F.col("last_seq")) & (F.col("first_seq") >= 0) & (F.col("last_seq") < F.coalesce("log_size", F.lit(0))))
    d = d.withColumn("counted", F.coalesce(F.col("in_range") & (F.col("last_seq") - F.col("first_seq") + 1 == F.col("entry_count")), F.lit(False)))
    wanted = d.where("counted").select(log, "segment_id", "first_seq", "last_seq")
    met = binned(entries.select(log, pos, "chain_hash"), wanted, log, pos, "first_seq", "last_seq")
    got = met.groupBy(log, "segment_id").agg(F.max_by("chain_hash", pos).alias("head"), ordered(entry_leaf(F.col("chain_hash")), F.col(pos)).alias("leaves"))
    got = got.withColumn("log_root", to_hex(root(F.col("leaves")))).drop("leaves")
    status = (
        F.when(~F.coalesce("in_range", F.lit(False)), "OUT_OF_RANGE")
        .when(~F.col("counted"), "COUNT_MISMATCH")
        .when(~F.col("log_root").eqNullSafe(F.col("merkle_root")), "ROOT_MISMATCH")
        .when(~F.col("head").eqNullSafe(F.col("head_chain_hash_at_close")), "HEAD_MISMATCH")
        .otherwise("OK")
    )
    return d.join(got, [log, "segment_id"], "left").select(log, "segment_id", status.alias("status"))


def coverage_gaps(found: DataFrame, log: str = "log_id") -> DataFrame:
    """Manifests that don't begin where the one before ended: linkage alone doesn't show them."""
    w = Window.partitionBy(log).orderBy("segment_id")
    d = found.withColumn("want_first", F.coalesce(F.lag("last_seq").over(w) + 1, F.lit(0)))
    return d.where("first_seq <> want_first").select(log, "segment_id", "first_seq", "want_first")


def covering(entries: DataFrame, found: DataFrame, log: str = "log_id") -> DataFrame:
    """Entries with the first manifest (smallest segment_id) whose range holds their seq; ranges may overlap.

    A manifest that claims more than its log holds is cut to it. See operators.sweep: no range is spelled out.
    """
    held = entries.groupBy(log).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    cut = found.join(held, log).select(log, "segment_id", F.greatest("first_seq", "low").alias("first_seq"), F.least("last_seq", "high").alias("last_seq"))
    return carried(entries, first_owners(cut, log, "first_seq", "last_seq", "segment_id"), log, "seq", "first_seq", "last_seq", "segment_id")


def proofs(entries: DataFrame, found: DataFrame, log: str = "log_id") -> DataFrame:
    """Inclusion proofs of all sealed entries, each checked against its manifest's root (column verified)."""
    cov = covering(entries.select(log, "seq", "chain_hash"), found, log)
    cov = cov.withColumn("leaf", entry_leaf(F.col("chain_hash")))
    trees = cov.groupBy(log, "segment_id").agg(ordered(F.struct("seq", "leaf"), F.col("seq")).alias("rows"))
    # each leaf leaves its tree with its own path only; the levels are bound once for a tree
    path = lambda tree: F.transform("rows", lambda r, i: F.struct(i.cast("long").alias("leaf_index"), r["seq"].alias("entry_seq"), r["leaf"].alias("leaf"), audit_path(tree, i).alias("audit_path")))
    found_paths = F.get(F.transform(F.array(levels(F.transform("rows", lambda r: r["leaf"]))), path), F.lit(0))
    rows = trees.select(log, "segment_id", F.size("rows").cast("long").alias("tree_size"), F.explode_outer(found_paths).alias("r")).select(log, "segment_id", "tree_size", "r.*")
    out = rows.join(found.select(log, "segment_id", "merkle_root", "segment_chain_hash"), [log, "segment_id"])
    verified = verify_path(F.col("leaf"), F.col("leaf_index"), F.col("tree_size"), F.col("audit_path"), F.col("merkle_root"))
    return out.select(log, F.lit(PROOF_SCHEMA).alias("schema"), "entry_seq", to_hex(F.col("leaf")).alias("leaf_hash"), "leaf_index", "tree_size", "merkle_root", "segment_id", "segment_chain_hash", "audit_path", verified.alias("verified"))


def unsealed(entries: DataFrame, found: DataFrame, log: str = "log_id") -> DataFrame:
    """Entries after the last sealed one of their log."""
    last = found.groupBy(log).agg(F.max("last_seq").alias("sealed_to"))
    return entries.join(last, log, "left").where("sealed_to IS NULL OR seq > sealed_to").drop("sealed_to")


def seal_counts(entries: DataFrame, found: DataFrame, log: str = "log_id") -> DataFrame:
    """(log, segments_sealed, entries_sealed, open_entries)."""
    sealed = found.groupBy(log).agg(F.count("*").alias("segments_sealed"), F.sum("entry_count").alias("entries_sealed"))
    total = entries.groupBy(log).agg(F.count("*").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = total.join(sealed, log, "left").select(log, "total", zero("segments_sealed"), zero("entries_sealed"))
    return out.select(log, "segments_sealed", "entries_sealed", (F.col("total") - F.col("entries_sealed")).alias("open_entries"))
