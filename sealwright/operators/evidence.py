"""Checks that join a log with what stands beside it: rule packs, time-stamp responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwright.functions.hashing import contains_imprint, stamp_imprint


def lineage_mismatches(entries: DataFrame, packs: DataFrame, log: str = "log_id") -> DataFrame:
    """Entries whose pack's hash isn't the one on disk (status MISMATCH), or whose pack isn't there (MISSING).

    packs: (policy_set, disk_hash). One row for each log, pack and recorded hash, with the first seq and the count.
    """
    used = entries.groupBy(log, "policy_set", "policy_hash").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    met = used.join(packs, "policy_set", "left")
    status = F.when(F.col("disk_hash").isNull(), "MISSING").when(F.col("disk_hash") != F.col("policy_hash"), "MISMATCH").otherwise("OK")
    return met.withColumn("status", status).where("status <> 'OK'").select(log, "policy_set", "policy_hash", "disk_hash", "first_seq", "n", "status")


def verify_stamps(manifests: DataFrame, responses: DataFrame, log: str = "log_id", segment_id: int | None = None) -> DataFrame:
    """(log, segment_id, status): missing, ok or fail by whether the response holds the segment's imprint.

    responses: (log, segment_id, content). The content is searched as bytes; it isn't parsed.
    """
    found = manifests if segment_id is None else manifests.where(F.col("segment_id") == segment_id)
    met = found.select(log, "segment_id", "segment_chain_hash").join(responses.select(log, "segment_id", "content"), [log, "segment_id"], "left")
    status = F.when(F.col("content").isNull(), "missing").when(contains_imprint(F.col("content"), stamp_imprint(F.col("segment_chain_hash"))), "ok").otherwise("fail")
    return met.select(log, "segment_id", status.alias("status"))


def stamp_summary(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("n"))
