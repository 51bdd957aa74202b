"""The checks and tree functions for SQL texts: temporary SQL functions, which Spark puts into the plan as expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DIGITS = "regexp_replace(x, '[^0-9]', '')"
# the rest of a number modulo 97, letters standing for 10 to 35
_LETTER = "coalesce(try_cast(c AS INT), ascii(upper(c)) - 55)"
_TURNED = r"concat(substr(regexp_replace(x, r'(?U)\s', ''), 5), substr(regexp_replace(x, r'(?U)\s', ''), 1, 4))"
_REST = f"aggregate(split({_TURNED}, ''), 0, (r, c) -> CASE WHEN c = '' THEN r ELSE (r * CASE WHEN {_LETTER} > 9 THEN 100 ELSE 10 END + {_LETTER}) % 97 END)"
_PESEL_SUM = f"aggregate(sequence(1, 10), 0, (a, i) -> a + coalesce(try_cast(substr({_DIGITS}, i, 1) AS INT), 0) * element_at(array(1, 3, 7, 9, 1, 3, 7, 9, 1, 3), i))"
_MONTH, _DAY, _CHECK = (f"try_cast(substr({_DIGITS}, {a}, {n}) AS INT)" for a, n in ((3, 2), (5, 2), (11, 1)))
_NODE = "unhex(sha2(concat(unhex('01'), {0}, {1}), 256))"
_OTHER = "unhex(get(path, a.used))"
_PAIRED = "(a.n > 1 AND (a.i % 2 = 1 OR a.i + 1 < a.n))"
_STEP = f"""named_struct(
  'h', CASE WHEN {_PAIRED} THEN CASE WHEN a.i % 2 = 1 THEN {_NODE.format(_OTHER, "a.h")} ELSE {_NODE.format("a.h", _OTHER)} END ELSE a.h END,
  'i', CASE WHEN a.n > 1 THEN a.i DIV 2 ELSE a.i END, 'n', CASE WHEN a.n > 1 THEN (a.n + 1) DIV 2 ELSE a.n END, 'used', CASE WHEN {_PAIRED} THEN a.used + 1 ELSE a.used END)"""

FUNCTIONS = {
    "luhn_ok": ("x STRING", "BOOLEAN", f"coalesce(length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS}), false)"),
    "pesel_ok": ("x STRING", "BOOLEAN", f"coalesce(length({_DIGITS}) = 11 AND {_MONTH} % 20 BETWEEN 1 AND 12 AND {_DAY} BETWEEN 1 AND 31 AND (10 - {_PESEL_SUM} % 10) % 10 = {_CHECK}, false)"),
    "iban_ok": ("x STRING", "BOOLEAN", f"coalesce(CASE WHEN octet_length(regexp_replace(x, r'(?U)\\s', '')) BETWEEN 15 AND 34 AND regexp_replace(x, r'(?U)\\s', '') RLIKE '^[0-9A-Za-z]+$' THEN {_REST} = 1 END, false)"),
    "tree_leaf": ("chain_hash STRING", "BINARY", "unhex(sha2(concat(unhex('00'), unhex(chain_hash)), 256))"),
    "tree_node": ("a BINARY, b BINARY", "BINARY", _NODE.format("a", "b")),
    "verify_audit_path": (
        "leaf BINARY, position BIGINT, size BIGINT, path ARRAY<STRING>, root STRING",
        "BOOLEAN",
        f"""coalesce(position >= 0 AND position < size AND aggregate(sequence(1, length(bin(size - 1))), named_struct('h', leaf, 'i', position, 'n', size, 'used', 0),
          (a, s) -> {_STEP}, a -> a.used = size(path) AND lower(hex(a.h)) = root), false)""".replace("size(path)", "cardinality(path)"),
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Defines luhn_ok, pesel_ok, iban_ok, tree_leaf, tree_node and verify_audit_path for the session's SQL, and the table function audit_path.

    They say the same as the column functions of this package: nulls fail a check, and a path of the wrong length fails.
    """
    from sealwright.operators.pathtable import AuditPath

    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("audit_path", AuditPath)
