"""Digests: of texts, chain links, tree leaves and nodes, segments, and time-stamp requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def sha256_bytes(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def from_hex(x: Column) -> Column:
    """Bytes of a hex text; an error where it isn't one (Spark alone gives null)."""
    return F.when(x.isNull() | (x.rlike("^[0-9a-fA-F]*$") & (F.length(x) % 2 == 0)), F.unhex(x)).otherwise(F.raise_error(F.concat(F.lit("not hex: "), x)).cast("binary"))


def leaf_hash(data: Column) -> Column:
    return sha256_bytes(F.concat(F.unhex(F.lit("00")), data))


def node_hash(left: Column, right: Column) -> Column:
    return sha256_bytes(F.concat(F.unhex(F.lit("01")), left, right))


EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def entry_leaf(chain_hash: Column) -> Column:
    return leaf_hash(from_hex(chain_hash))


CHAIN_FIELDS = ["decision", "policy_set", "policy_hash", "context", "input_hash", "shadow_hash"]


def chain_digest(prev: Column, **fields: Column) -> Column:
    """The link of an entry to the one before it; null if a field is null (concat_ws would skip it)."""
    parts = [prev, *(fields.get(f, F.col(f)) for f in CHAIN_FIELDS), fields.get("seq", F.col("seq")).cast("string"), fields.get("timestamp", F.col("timestamp"))]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.sha2(joined, 256)


def segment_digest(prev_chain: Column, root: Column, first: Column, last: Column, sealed_at: Column) -> Column:
    bar = F.lit("|")
    return F.sha2(F.concat(prev_chain, bar, root, bar, first.cast("string"), bar, last.cast("string"), bar, sealed_at), 256)


def stamp_imprint(segment_chain_hash: Column) -> Column:
    return from_hex(segment_chain_hash)


def der_length(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    body = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([0x80 | len(body)]) + body


def der_sequence(*parts: bytes) -> bytes:
    body = b"".join(parts)
    return b"\x30" + der_length(len(body)) + body


_SHA256_OID = bytes.fromhex("0609608648016503040201")  # fixed value: 2.16.840.1.101.3.4.2.1 in DER
IMPRINT_TAG = b"\x04\x20"


def _request_ends() -> tuple[bytes, bytes]:
    """What stands around the digest in a request: version 1, algorithm, imprint, certificate wanted."""
    mark = bytes(32)
    imprint = der_sequence(der_sequence(_SHA256_OID, b"\x05\x00"), IMPRINT_TAG + mark)
    whole = der_sequence(b"\x02\x01\x01", imprint, b"\x01\x01\xff")
    at = whole.index(IMPRINT_TAG + mark) + 2
    return whole[:at], whole[at + 32 :]


def stamp_request(digest: Column) -> Column:
    before, after = _request_ends()
    return F.concat(F.unhex(F.lit(before.hex())), digest, F.unhex(F.lit(after.hex())))


def contains_imprint(response: Column, digest: Column) -> Column:
    """Whether the tagged digest stands anywhere in a response, as bytes."""
    return F.contains(response, F.concat(F.unhex(F.lit(IMPRINT_TAG.hex())), digest))
