"""Counters as observed metrics: what a plan counts on its way, without a job of its own, and what streams add up."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

DECISIONS, SEALS, STAMPS = "decisions", "seals", "stamps"


def _observed(df: DataFrame, name: str | Observation, **metrics) -> DataFrame:
    return df.observe(name, *(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in metrics.items()))


def observe_decisions(evaluated: DataFrame, name: str | Observation = DECISIONS) -> DataFrame:
    """The same rows; counts requests, each decision, and rows rejected as their pack isn't loaded."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return _observed(evaluated, name, requests=F.count("*"), allow=of("ALLOW"), review=of("REVIEW"), deny=of("DENY"), rejected=F.count_if(F.col("decision").isNull()))


def observe_seals(sealed: DataFrame, name: str | Observation = SEALS) -> DataFrame:
    """The same rows of seal_stream; counts entries written, segments sealed and the entries in them."""
    is_manifest = F.col("kind") == "manifest"
    return _observed(sealed, name, entries=F.count_if(F.col("kind") == "entry"), segments_sealed=F.count_if(is_manifest), entries_sealed=F.sum(F.when(is_manifest, F.col("entry_count"))))


def observe_stamps(answers: DataFrame, name: str | Observation = STAMPS) -> DataFrame:
    """The same rows of stamping.ask; counts answers stored and requests that failed."""
    return _observed(answers, name, stored=F.count_if(F.col("status") == "stored"), failed=F.count_if(F.col("status") == "failed"))


class Counters(StreamingQueryListener):
    """Sums the observed metrics of all streaming queries of a session, and counts batches, rows and queries that failed.

    spark.streams.addListener(c) starts it. Batches reach it a moment after they end. A batch that is run once more after a
    failure counts when it ends, so its metrics are in once.
    """

    def __init__(self):
        self._lock = threading.Lock()
        self._sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self._seen: set[tuple[str, int]] = set()

    def _add(self, name: str, **values: int) -> None:
        for k, v in values.items():
            self._sums[name][k] += v

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._add("queries", started=1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            if (str(p.id), p.batchId) in self._seen:  # an idle query tells its last batch again
                return
            self._seen.add((str(p.id), p.batchId))
            self._add("queries", batches=1, input_rows=max(0, p.numInputRows))
            for name, row in p.observedMetrics.items():
                self._add(name, **{k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._add("queries", **({"failed": 1} if event.exception else {"ended": 1}))

    def count(self, name: str, **values: int) -> None:
        """Adds counts that no plan observes."""
        with self._lock:
            self._add(name, **values)

    def totals(self) -> dict[str, dict[str, int]]:
        with self._lock:
            return {k: dict(v) for k, v in self._sums.items()}


def totals_of(query: StreamingQuery) -> dict[str, dict[str, int]]:
    """Sums of an ended query's observed metrics, as far back as its session keeps progress (spark.sql.streaming.numRecentProgressUpdates)."""
    c = Counters()
    for p in query.recentProgress:
        for name, row in p.observedMetrics.items():
            c._add(name, **{k: v or 0 for k, v in row.asDict().items()})
    return c.totals()
