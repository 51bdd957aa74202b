"""Settings, with an overlay from environment variables that begin with SEALWRIGHT_."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass

# The seeds of a log's and of a segment chain's first link.
AUDIT_GENESIS = "b93b4ade8c758fa0086b464ac445fe6109681da57a99760eeb7f7bce3623562d"
SEGMENT_GENESIS = "68856029989354a47760a65ea30238356db77c609f595c6192dcdc6c7c5a4097"


@dataclass(frozen=True)
class Settings:
    policies_dir: str = "policies"
    trusted_signers_file: str = "policies/trusted_signers.json"
    enforce_signatures: bool = True
    default_policy_set: str = "finance-v1"
    audit_log_path: str = "logs/audit.jsonl"
    segments_dir: str = "logs/segments"
    segment_size: int = 1000
    segment_interval_seconds: int = 60
    tsa_url: str = ""
    tsa_timeout_seconds: int = 10
    audit_genesis: str = AUDIT_GENESIS
    segment_genesis: str = SEGMENT_GENESIS
    allowed_origins: tuple[str, ...] = ()


def origins(value: str | list[str] | None) -> tuple[str, ...]:
    """A list, or one comma-separated text; blanks go."""
    parts = value.split(",") if isinstance(value, str) else value or []
    return tuple(p.strip() for p in parts if p.strip())


def load_settings(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    found = {}
    for f in dataclasses.fields(Settings):
        raw = env.get(f"SEALWRIGHT_{f.name.upper()}")
        if raw is None:
            continue
        default = f.default
        if f.name == "allowed_origins":
            found[f.name] = origins(raw)
        elif isinstance(default, bool):
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(default, int):
            found[f.name] = int(raw)
        else:
            found[f.name] = raw
    return Settings(**found)
