"""How many pieces to cut a job into, from Spark's own estimate of its input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

_UNKNOWN = 1 << 57  # Spark's estimate where it knows nothing is far beyond this


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """Partitions of about part_bytes each; the session's shuffle partitions where the size isn't known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= _UNKNOWN:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(size / part_bytes))
