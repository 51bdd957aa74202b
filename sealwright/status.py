"""What a running audit session says about itself: whether it takes entries, and by which packs and formats."""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession

from sealwright.model import AUDIT_SCHEMA, PROOF_SCHEMA, SEGMENT_SCHEMA
from sealwright.plans.packs import load_packs
from sealwright.plans.signing import Signers
from sealwright.sources.logs import LogWriter

VERSION = "0.3.0"


def status(policies_dir: str, signers: Signers | None, audit_genesis: str, segment_genesis: str, log: LogWriter | None = None, spark: SparkSession | None = None) -> dict:
    """status: ready, or halted once an append to `log` has failed. All packs of the folder are loaded and, with signers, verified: one that can't be is an error.

    Beside it the packs' versions and hashes, whether signatures are enforced, and the formats and first links in use.
    """
    names = sorted({os.path.splitext(os.path.basename(p))[0] for end in ("json", "yaml", "yml") for p in glob.glob(os.path.join(policies_dir, f"*.{end}"))} - {"trusted_signers"})
    packs = load_packs(names, policies_dir, signers, spark)
    halted = log is not None and log.halted
    return {
        "status": "halted" if halted else "ready",
        "version": VERSION,
        "policies_loaded": len(packs),
        "policies": {p.name: {"version": p.version, "hash": p.pack_hash, "rules": len(p.rules)} for p in packs.values()},
        "signature_enforcement": signers is not None,
        "schemas": [AUDIT_SCHEMA, SEGMENT_SCHEMA, PROOF_SCHEMA],
        "genesis": {"audit": audit_genesis, "segment": segment_genesis},
    } | ({"reason": "an append failed, so the log takes no more entries"} if halted else {})
