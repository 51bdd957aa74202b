"""Rule packs: loading, checking and compiling them for Java's regular expressions.

Packs are read on the driver before any job starts and become literal column expressions, so that
a bad pack stops the run and tasks do no look-ups.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sealwright.errors import PackError
from sealwright.functions.validators import VALIDATORS
from sealwright.plans.dialect import PatternError, parse, to_java
from sealwright.plans.signing import Signers, verify

BUILT_IN = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "packs")
SHIPPED = ("finance-v1", "medtech-v1", "hr-bias-v1")
@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    action: str
    score: float
    validator: str | None = None
    context: str | None = None


@dataclass(frozen=True)
class Pack:
    name: str
    version: str
    pack_hash: str
    rules: tuple[Rule, ...] = field(default=())


def compile_pattern(pattern: str, where: str = "pattern") -> str:
    """The same pattern for Java, any case; see plans.dialect. What the dialect doesn't have is refused."""
    try:
        return "(?iuUd)" + to_java(parse(pattern))
    except PatternError as e:
        raise PackError(f"{where}: {e}: {pattern}") from e


def parse_pack(data: bytes, stem: str) -> Pack:
    """A pack from its file's bytes; stem: the file's name without ending, which must be the pack's."""
    try:
        text = data.decode("utf-8")
        if text.lstrip().startswith("{"):
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
        rules = []
        for r in raw["rules"]:
            v = r.get("validator")
            if v is not None and v not in VALIDATORS:
                raise PackError(f"{stem}: rule {r['id']}: unknown validator {v}")
            rules.append(Rule(str(r["id"]), str(r["pattern"]), str(r["action"]), float(r["score"]), v, (r.get("conditions") or {}).get("context")))
        name, version = str(raw["name"]), str(raw["version"])
    except PackError:
        raise
    except Exception as e:
        raise PackError(f"{stem}: can't be parsed: {e}") from e
    if name != stem:
        raise PackError(f"{stem}: the pack names itself {name}")
    for r in rules:
        compile_pattern(r.pattern, f"{stem}: rule {r.id}")
        if r.context is not None:
            compile_pattern(r.context, f"{stem}: rule {r.id}, context")
    return Pack(name, version, hashlib.sha256(data).hexdigest(), tuple(rules))


def _path(name: str, folder: str) -> str:
    for end in (".yaml", ".yml", ".json"):
        if os.path.isfile(p := os.path.join(folder, name + end)):
            return p
    raise PackError(f"no pack {name} in {folder}")


def load_pack(name: str, folder: str = BUILT_IN, signers: Signers | None = None, spark: SparkSession | None = None) -> Pack:
    """Reads a pack. With signers, its .signer and .sig files must name a trusted key and fit the bytes;
    a bad signature is reported before a bad pack."""
    path = _path(name, folder)
    with open(path, "rb") as f:
        data = f.read()
    if signers is not None:
        try:
            with open(path + ".signer") as f:
                signer = f.read().strip()
            with open(path + ".sig") as f:
                signature = f.read().strip()
        except OSError as e:
            raise PackError(f"{name}: signature files: {e}") from e
        if signer not in signers.keys:
            raise PackError(f"{name}: signer {signer} isn't trusted")
        if not verify(spark, signers.keys[signer], data, signature):
            raise PackError(f"{name}: the signature of {signer} doesn't fit")
    return parse_pack(data, name)


def load_packs(names=SHIPPED, folder: str = BUILT_IN, signers: Signers | None = None, spark: SparkSession | None = None) -> dict[str, Pack]:
    """All packs or none: the gate before any job starts."""
    return {n: load_pack(n, folder, signers, spark) for n in names}


def rules_frame(spark: SparkSession, packs: dict[str, Pack]) -> DataFrame:
    rows = [(p.name, i, r.id, r.pattern, r.action, r.score, r.validator, r.context) for p in packs.values() for i, r in enumerate(p.rules)]
    return spark.createDataFrame(rows, "pack string, ord int, id string, pattern string, action string, score float, validator string, context_pattern string")
