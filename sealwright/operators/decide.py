"""Rule evaluation: violations in rule order and a decision for each interaction, in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.functions.hashing import sha256_hex
from sealwright.functions.normalize import original_text, shadow
from sealwright.functions.validators import VALIDATORS
from sealwright.model import AUDIT_SCHEMA, VIOLATION
from sealwright.plans.packs import Pack, Rule, compile_pattern


def rule_fires(rule: Rule, context: Column, text: Column) -> Column:
    """Whether a rule's gate matches the raw context, its pattern the shadow text, and its validator the first match.

    Later matches are not tried, as the first one decides.
    """
    pattern = compile_pattern(rule.pattern)
    if rule.validator is None:
        hit = text.rlike(pattern)
    else:  # the match is bound once; no validator passes the empty text that stands for no match
        hit = F.exists(F.array(F.regexp_extract(text, pattern, 0)), VALIDATORS[rule.validator])
    if rule.context is not None:
        hit = context.rlike(compile_pattern(rule.context)) & hit
    return F.coalesce(hit, F.lit(False))


def violations(pack: Pack, context: Column, text: Column) -> Column:
    found = [
        F.when(
            rule_fires(r, context, text),
            F.struct(F.lit(r.id).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.score).cast("float").alias("confidence"), F.lit(r.validator).cast("string").alias("validator")),
        )
        for r in pack.rules
    ]
    return F.array_compact(F.array(*found)).cast(f"array<{VIOLATION.simpleString()}>")


def decision(found: Column) -> Column:
    """DENY before REVIEW before ALLOW; other actions are recorded but decide nothing."""
    has = lambda action: F.exists(found, lambda v: F.lower(v["action"]) == action)
    return F.when(has("deny"), "DENY").when(has("review"), "REVIEW").otherwise("ALLOW")


def by_pack(packs: dict[str, Pack], policy_set: Column, value) -> Column:
    """value(pack) for the row's pack; null for packs that aren't loaded."""
    return reduce(lambda rest, p: F.when(policy_set == p.name, value(p)).otherwise(rest), packs.values(), F.lit(None))


def evaluate(df: DataFrame, packs: dict[str, Pack], default: str = "finance-v1", normal: bool = False) -> DataFrame:
    """Adds original, shadow, input_hash, shadow_hash, policy_set, policy_hash, violations and decision to
    rows of context, prompt, response and policy_set (null: the default pack).

    normal: all text is known to be NFKC already. Rows whose pack isn't loaded have null
    violations and decision; see split_known.
    """
    out = df.withColumn("policy_set", F.coalesce(F.col("policy_set"), F.lit(default)))
    out = out.withColumn("original", original_text(F.col("context"), F.col("prompt"), F.col("response")))
    out = out.withColumn("shadow", shadow(F.col("original"), normal))
    out = out.withColumn("input_hash", sha256_hex(F.col("original"))).withColumn("shadow_hash", sha256_hex(F.col("shadow")))
    out = out.withColumn("policy_hash", by_pack(packs, F.col("policy_set"), lambda p: F.lit(p.pack_hash)))
    out = out.withColumn("violations", by_pack(packs, F.col("policy_set"), lambda p: violations(p, F.col("context"), F.col("shadow"))))
    return out.withColumn("decision", F.when(F.col("violations").isNotNull(), decision(F.col("violations"))))


def split_known(df: DataFrame, packs: dict[str, Pack], default: str = "finance-v1") -> tuple[DataFrame, DataFrame]:
    """(rows whose pack is loaded, rows to reject)."""
    known = F.coalesce(F.col("policy_set"), F.lit(default)).isin(*packs)
    return df.where(known), df.where(~known)


def entries(evaluated: DataFrame) -> DataFrame:
    """Entry columns of evaluated rows that have seq and timestamp, all but the two chain hashes."""
    return evaluated.select(
        F.lit(AUDIT_SCHEMA).alias("schema"), "seq", F.uuid().alias("audit_id"), "timestamp", "decision", "policy_set", "policy_hash", "context", "input_hash", "shadow_hash", "violations"
    )


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("decision", "policy_set").agg(F.count("*").alias("n"))


def rule_hits(df: DataFrame) -> DataFrame:
    """Hits of each rule, over the array of violations.

    The outer explode keeps Spark from evaluating all rules once more in a filter on the array's size.
    """
    return df.select("policy_set", F.explode_outer("violations").alias("v")).where("v IS NOT NULL").groupBy("policy_set", F.col("v.rule").alias("rule"), F.col("v.action").alias("action")).agg(F.count("*").alias("n"))
