"""Schemas of requests, entries, manifests and proofs."""

from pyspark.sql import types as T

VIOLATION = T.StructType([T.StructField("rule", T.StringType()), T.StructField("action", T.StringType()), T.StructField("confidence", T.FloatType()), T.StructField("validator", T.StringType())])
REQUEST = T.StructType(
    [T.StructField("context", T.StringType(), False), T.StructField("policy_set", T.StringType()), T.StructField("payload", T.StructType([T.StructField("prompt", T.StringType(), False), T.StructField("response", T.StringType(), False)]), False)]
)
_text = lambda names: [T.StructField(n, T.StringType()) for n in names]
ENTRY = T.StructType(
    [T.StructField("schema", T.StringType()), T.StructField("seq", T.LongType()), *_text(["audit_id", "timestamp", "decision", "policy_set", "policy_hash", "context", "input_hash", "shadow_hash"]), T.StructField("violations", T.ArrayType(VIOLATION)), *_text(["prev_hash", "chain_hash"])]
)
ENTRY_REQUIRED = [f.name for f in ENTRY]
MANIFEST = T.StructType(
    [T.StructField("schema", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("segment_id", "first_seq", "last_seq", "entry_count")), *_text(["merkle_root", "prev_merkle_root", "prev_segment_chain_hash", "segment_chain_hash", "head_chain_hash_at_close", "sealed_at", "tst_path"])]
)

# Format discriminators. A reader of other logs sets its own.
AUDIT_SCHEMA, SEGMENT_SCHEMA, PROOF_SCHEMA = "audit.v1", "segment.v1", "merkle-proof.v1"
