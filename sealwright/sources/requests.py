"""Audit requests as JSON lines, in batch or as a stream: one object a line, checked as strictly as a service would its bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.operators.decide import evaluate
from sealwright.plans.packs import Pack

MAX_BYTES = 65_536
_FIELDS = {"context": "$.context", "payload": "$.payload", "prompt": "$.payload.prompt", "response": "$.payload.response", "policy_set": "$.policy_set"}


def parse_requests(lines: DataFrame, max_bytes: int = MAX_BYTES, value: str = "value") -> DataFrame:
    """Lines (column value; others stay) as context, policy_set, prompt, response and problem.

    problem is null for a request; else: too large (over max_bytes), not JSON (also for an object that names a field twice), or
    what is missing or of another kind than text. policy_set may be left out or null. Unknown fields are ignored. Blank lines aren't
    requests and have no row. A rejected line's fields are null.
    """
    rest = [c for c in lines.columns if c != value]
    line = F.col(value)
    parsed = lines.where(F.trim(line) != "").withColumn("large", F.octet_length(line) > max_bytes)
    # the parser stops after the first value; nothing but white space can follow it if it also parses as an item and as a member
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), line, F.lit(b))).isNotNull()
    parsed = parsed.withColumn("v", F.when(~F.col("large") & inside("[", "]") & inside('{"x":', "}"), F.try_parse_json(line)))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", _FIELDS[name], "variant"))
    is_text = lambda name: kind(name).eqNullSafe(F.lit("STRING"))
    odd = [F.when(~is_text(n), F.lit(n)) for n in ("context", "prompt", "response")]
    odd.append(F.when(~(is_text("policy_set") | F.coalesce(kind("policy_set") == "VOID", F.lit(True))), F.lit("policy_set")))
    wrong = F.array_compact(F.array(*odd))
    problem = (
        F.when(F.col("large"), "too large")
        .when(F.col("v").isNull() | ~F.startswith(F.coalesce(F.schema_of_variant("v"), F.lit("")), F.lit("OBJECT")), "not JSON")
        .when(F.size(wrong) > 0, F.concat(F.lit("not text: "), F.array_join(wrong, ", ")))
    )
    text = lambda name: F.when(F.col("problem").isNull(), F.try_variant_get("v", _FIELDS[name], "string")).alias(name)
    return parsed.withColumn("problem", problem).select(*rest, *(text(n) for n in ("context", "policy_set", "prompt", "response")), "problem")


def read_requests(spark: SparkSession, path: str, stream: bool = False, max_bytes: int = MAX_BYTES, **options) -> DataFrame:
    """Requests of text files, or of files as they arrive."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    return parse_requests(reader.text(path), max_bytes)


def audit_requests(requests: DataFrame, packs: dict[str, Pack], default: str = "finance-v1") -> DataFrame:
    """Requests with what evaluate adds, and a status: 200 decided, 400 rejected for its problem, 404 for a pack that isn't loaded.

    The same for a batch and a stream, as it is one projection. policy_set becomes the pack that was used. Rejected rows have null decisions.
    """
    decided = evaluate(requests, packs, default)
    status = F.when(F.col("problem").isNotNull(), 400).when(F.col("violations").isNull(), 404).otherwise(200)
    decided = decided.withColumn("status", status)
    empty = lambda c: F.when(F.col("status") == 200, F.col(c)).alias(c)
    decided = decided.withColumn("policy_set", F.when(F.col("status") != 400, F.col("policy_set")))
    return decided.select(*requests.columns, *(empty(c) for c in ("policy_hash", "input_hash", "shadow_hash", "violations", "decision")), "status")
