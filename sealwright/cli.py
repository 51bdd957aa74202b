"""Command line: replay and verify logs and segments, print proofs, check time stamps, make keys and sign packs.

Exit codes: 0 all well, 1 unreadable or unknown, 2 chain broken, 3 other rule packs, 4 segment chain broken,
5 manifests, proofs and log differ, 6 a time stamp is for something else, 78 rule packs can't be trusted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.config import AUDIT_GENESIS, SEGMENT_GENESIS, load_settings
from sealwright.errors import AuditError, ChainBreak, LineageMismatch, ManifestMismatch, SegmentError, TimestampError
from sealwright.operators import chain, evidence, segments
from sealwright.plans.packs import load_pack
from sealwright.plans.signing import Signers, keygen, sign
from sealwright.sources.logs import publish, read_log, read_manifests, read_stamps
from sealwright.status import status


def _as_one_log(df: DataFrame) -> DataFrame:
    return df.withColumn("log_id", F.lit("log"))


def load_log(spark: SparkSession, path: str) -> DataFrame:
    return _as_one_log(read_log(spark, path))


def check_chain(log: DataFrame, genesis: str = AUDIT_GENESIS) -> tuple[int, str]:
    """(entries, head), or the first break as an error."""
    bad = chain.first_breaks(chain.verify_chain(log, genesis=genesis)).first()
    if bad:
        raise ChainBreak(f"entry {bad['pos']}: {bad['status']}: expected {bad['expected']}, found {bad['found']}")
    end = chain.heads(log).first()
    return log.count(), end["chain_hash"] if end else genesis


def check_lineage(spark: SparkSession, log: DataFrame, folder: str, signers: Signers | None) -> int:
    names = [r[0] for r in log.select("policy_set").distinct().collect()]
    packs = [(n, load_pack(n, folder, signers, spark).pack_hash) for n in names]
    bad = evidence.lineage_mismatches(log, spark.createDataFrame(packs, "policy_set string, disk_hash string")).orderBy("first_seq").first() if packs else None
    if bad:
        raise LineageMismatch(f"entry {bad['first_seq']}: {bad['policy_set']} was {bad['policy_hash']}, is {bad['disk_hash']}")
    return log.count()


def check_segments(found: DataFrame, genesis: str = SEGMENT_GENESIS) -> tuple[int, str]:
    bad = segments.verify_segment_chain(found, genesis=genesis).where("status <> 'OK'").orderBy("segment_id").first()
    if bad:
        raise SegmentError(f"segment {bad['segment_id']}: {bad['status']}")
    last = found.orderBy(F.desc("segment_id")).first()
    return found.count(), last["segment_chain_hash"] if last else genesis


def check_manifests(found: DataFrame, log: DataFrame) -> None:
    bad = segments.verify_against_log(found, log).where("status <> 'OK'").orderBy("segment_id").first()
    if bad:
        raise ManifestMismatch(f"segment {bad['segment_id']}: {bad['status']}")


def prove(found: DataFrame, log: DataFrame, seq: int) -> dict:
    """The inclusion proof of the entry at a position. A log that is shorter than the segment, a broken hash in it, or a
    proof that doesn't lead to the sealed root means that log and manifests differ."""
    covering = found.where(F.lit(seq).between(F.col("first_seq"), F.col("last_seq"))).orderBy("segment_id")
    own = covering.first()
    if own is None:
        last = found.agg(F.max("last_seq")).first()[0]
        raise AuditError(f"no segment holds entry {seq}; the last sealed one is {-1 if last is None else last}")
    slice_ = log.where(F.col("pos").between(own["first_seq"], own["last_seq"])).withColumn("seq", F.col("pos"))
    held = slice_.agg(F.count("*").alias("n"), F.count_if(~F.col("chain_hash").rlike("^([0-9a-fA-F]{2})*$")).alias("broken")).first()
    if held["n"] != own["last_seq"] - own["first_seq"] + 1:
        raise ManifestMismatch(f"segment {own['segment_id']} holds entries {own['first_seq']} to {own['last_seq']}, the log only {log.count()} entries")
    if held["broken"]:
        raise ManifestMismatch(f"segment {own['segment_id']}: {held['broken']} entries have no chain hash in hex")
    got = segments.proofs(slice_, covering.limit(1)).where(F.col("entry_seq") == seq).drop("log_id").first()
    if not got["verified"]:
        raise ManifestMismatch(f"the proof of entry {seq} doesn't lead to the root of segment {own['segment_id']}")
    return got.asDict(recursive=True)


def check_stamps(found: DataFrame, stamps: DataFrame, segment_id: int | None) -> dict:
    if segment_id is not None and not found.where(F.col("segment_id") == segment_id).count():
        raise AuditError(f"no segment {segment_id}")
    rows = evidence.verify_stamps(found, stamps, segment_id=segment_id).orderBy("segment_id").collect()
    bad = [r["segment_id"] for r in rows if r["status"] == "fail"]
    if bad:
        raise TimestampError(f"segment {bad[0]}: the response is for another digest")
    return {"checked": sum(r["status"] == "ok" for r in rows), "missing": sum(r["status"] == "missing" for r in rows), "results": [{"segment_id": r["segment_id"], "status": r["status"]} for r in rows]}


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    s = load_settings()
    out: dict = {"status": "ok"}
    if args.command == "keygen":
        return out | {"public_key": keygen(spark, args.out, args.signer, args.trusted_signers)}
    if args.command == "sign":
        sign(spark, args.key, args.signer, args.files)
        return out | {"signed": len(args.files)}
    if args.command == "status":
        return status(args.policies_dir, Signers.load(args.trusted_signers) if s.enforce_signatures else None, s.audit_genesis, s.segment_genesis, spark=spark)
    if args.command in ("replay", "verify", "proof"):
        log = load_log(spark, args.log)
    if args.command == "replay":
        out["entries"], out["head_chain_hash"] = check_chain(log, s.audit_genesis)
        if args.verify_lineage:
            signers = None if args.no_signature_verify or not s.enforce_signatures else Signers.load(args.trusted_signers)
            out["verified_lineage"] = check_lineage(spark, log, args.policies_dir, signers)
        if args.verify_segments:
            found = _as_one_log(read_manifests(spark, args.segments))
            out["segments"], out["head_segment_chain_hash"] = check_segments(found, s.segment_genesis)
            check_manifests(found, log)
        return out
    found = _as_one_log(read_manifests(spark, args.segments))
    if args.command == "proof":
        return prove(found, log, args.seq)
    if args.command == "verify-tst":
        return out | check_stamps(found, _as_one_log(read_stamps(spark, args.segments)), args.segment_id)
    if args.command == "verify":
        out["entries"] = log.count()
    out["segments"], out["head_segment_chain_hash"] = check_segments(found, s.segment_genesis)
    if args.command == "verify":
        check_manifests(found, log)
    return out


def parser() -> argparse.ArgumentParser:
    s = load_settings()
    p = argparse.ArgumentParser(prog="sealwright", description=__doc__)
    p.add_argument("--report", help="also write what is printed to this file")
    sub = p.add_subparsers(dest="command", required=True)
    log, seg = {"default": s.audit_log_path}, {"default": s.segments_dir}
    r = sub.add_parser("replay")
    r.add_argument("--log", **log)
    r.add_argument("--segments", **seg)
    r.add_argument("--policies-dir", default=s.policies_dir)
    r.add_argument("--trusted-signers", default=s.trusted_signers_file)
    for flag in ("--verify-lineage", "--no-signature-verify", "--verify-segments"):
        r.add_argument(flag, action="store_true")
    for name in ("verify", "verify-chain", "proof", "verify-tst"):
        c = sub.add_parser(name)
        c.add_argument("--segments", **seg)
        if name in ("verify", "proof"):
            c.add_argument("--log", **log)
        if name == "proof":
            c.add_argument("--seq", type=int, required=True)
        if name == "verify-tst":
            c.add_argument("--segment-id", type=int)
    t = sub.add_parser("status")
    t.add_argument("--policies-dir", default=s.policies_dir)
    t.add_argument("--trusted-signers", default=s.trusted_signers_file)
    k = sub.add_parser("keygen")
    k.add_argument("--out", default="policies/signing.key")
    k.add_argument("--signer", required=True)
    k.add_argument("--trusted-signers", default=s.trusted_signers_file)
    g = sub.add_parser("sign")
    g.add_argument("--key", required=True)
    g.add_argument("--signer", required=True)
    g.add_argument("files", nargs="+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sealwright").getOrCreate()
    try:
        out, code = run(spark, args), 0
    except AuditError as e:
        out, code = {"status": "failed", "code": e.code, "error": str(e)}, e.code
    print(json.dumps(out), file=sys.stderr if code else sys.stdout)
    if args.report:
        publish(os.path.dirname(os.path.abspath(args.report)), os.path.basename(args.report), json.dumps(out, indent=2).encode())
    return code


if __name__ == "__main__":
    sys.exit(main())
