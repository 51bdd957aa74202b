"""Ed25519 keys and signatures by the JDK, on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from sealwright.errors import PackError

# What stands before the 32 key bytes in their DER forms.
_PUBLIC_HEAD = bytes.fromhex("302a300506032b6570032100")
_SECRET_HEAD = bytes.fromhex("302e020100300506032b657004220420")


@dataclass(frozen=True)
class Signers:
    """Trusted public keys (hex) by signer."""

    keys: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Signers:
        try:
            with open(path) as f:
                raw = json.load(f)
        except (OSError, ValueError) as e:
            raise PackError(f"trusted signers: {e}") from e
        return cls({k: public_key(v) for k, v in raw.items() if not k.startswith("_")})


def public_key(text: str) -> str:
    try:
        raw = bytes.fromhex(text.strip())
    except ValueError as e:
        raise PackError(f"public key: {e}") from e
    if len(raw) != 32:
        raise PackError(f"public key of {len(raw)} bytes")
    return raw.hex()


def verify(spark: SparkSession, key_hex: str, data: bytes, signature_hex: str) -> bool:
    try:
        signature = bytes.fromhex(signature_hex.strip())
    except ValueError:
        return False
    if len(signature) != 64:
        return False
    java = spark._jvm.java.security
    spec = java.spec.X509EncodedKeySpec(_PUBLIC_HEAD + bytes.fromhex(public_key(key_hex)))
    try:
        engine = java.Signature.getInstance("Ed25519")
        engine.initVerify(java.KeyFactory.getInstance("Ed25519").generatePublic(spec))
        engine.update(data)
        return bool(engine.verify(signature))
    except Exception:  # a point that isn't on the curve, or a malformed signature
        return False


def keygen(spark: SparkSession, out: str, signer: str, trusted: str) -> str:
    """Writes a secret key to out and the public one to out.key.pub's place, and registers the signer."""
    java = spark._jvm.java
    pair = java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = java.security.KeyFactory.getInstance("Ed25519")

    def raw(key, kind: str) -> str:  # the keys' own classes can't be called from here, their specifications can
        return bytes(factory.getKeySpec(key, java.lang.Class.forName(f"java.security.spec.{kind}EncodedKeySpec")).getEncoded())[-32:].hex()

    secret, public = raw(pair.getPrivate(), "PKCS8"), raw(pair.getPublic(), "X509")
    with os.fdopen(os.open(out, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        f.write(secret + "\n")
    with open(out + ".pub", "w") as f:
        f.write(public + "\n")
    known = {}
    if os.path.exists(trusted):
        with open(trusted) as f:
            known = json.load(f)
    known[signer] = public
    with open(trusted + ".tmp", "w") as f:
        json.dump(known, f, indent=2)
    os.replace(trusted + ".tmp", trusted)
    return public


def sign(spark: SparkSession, key_path: str, signer: str, files: list[str]) -> None:
    """Signs the bytes of each file; .sig and .signer files stand beside it."""
    with open(key_path) as f:
        seed = bytes.fromhex(f.read().strip())
    if len(seed) != 32:
        raise PackError(f"secret key of {len(seed)} bytes")
    java = spark._jvm.java.security
    key = java.KeyFactory.getInstance("Ed25519").generatePrivate(java.spec.PKCS8EncodedKeySpec(_SECRET_HEAD + seed))
    for path in files:
        with open(path, "rb") as f:
            data = f.read()
        engine = java.Signature.getInstance("Ed25519")
        engine.initSign(key)
        engine.update(data)
        with open(path + ".sig", "w") as f:
            f.write(bytes(engine.sign()).hex() + "\n")
        with open(path + ".signer", "w") as f:
            f.write(signer + "\n")
