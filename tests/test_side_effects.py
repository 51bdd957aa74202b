import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sealwright.functions.hashing import IMPRINT_TAG
from sealwright.streaming.counters import Counters, observe_decisions, observe_seals
from sealwright.streaming.stamping import StampSink, answers, stamp_stream, stored_stamps


def found(spark, n=6):
    return spark.range(n).select(F.lit("l").alias("log_id"), (F.col("id") + 1).alias("segment_id"), F.sha2(F.col("id").cast("string"), 256).alias("segment_chain_hash"))


def senders():
    """Local functions, as executors can't import this file."""

    def good(request):
        return b"x" + IMPRINT_TAG + request[24:56] + b"y"

    def broken(request):
        raise TimeoutError("slow")

    return good, broken


good, broken = senders()


def test_batches_are_stored_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    m = found(spark)
    StampSink(folder, broken)(m.where("segment_id <= 2"), 0)
    assert {(r.status, r.error) for r in answers(spark, folder).collect()} == {("failed", "TimeoutError: slow")} and stored_stamps(spark, folder).count() == 0
    StampSink(folder, good)(m, 0)  # batch 0 is complete: nothing happens
    assert answers(spark, folder).count() == 2
    StampSink(folder, good)(m.union(m), 1)  # what failed is asked about again, repeated rows once
    assert stored_stamps(spark, folder).count() == 6
    StampSink(folder, good)(m, 2)
    StampSink(folder, good)(m.withColumn("segment_chain_hash", F.lit(None).cast("string")), 3)
    assert stored_stamps(spark, folder).count() == 6 and answers(spark, folder).count() == 8
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()  # a run that was lost before its end
    StampSink(folder, good)(m, 1)
    assert stored_stamps(spark, folder).count() == 6


def test_wrong_answers_are_not_stored(spark, tmp_path):
    folder, counters = str(tmp_path / "out"), Counters()
    StampSink(folder, lambda r: b"nothing", counters)(found(spark), 0)
    assert counters.totals()["stamps"] == {"stored": 0, "failed": 6} and stored_stamps(spark, folder).count() == 0


def test_failures_do_not_stop_the_stream(spark, tmp_path):
    m = found(spark, 4)
    for i in (1, 2):
        m.where(F.col("segment_id") % 2 == i % 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counters, (yes, no) = Counters(), senders()
    some = lambda r: no(r) if r[24] % 2 else yes(r)
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stamp_stream(stream, some, str(tmp_path / "out"), str(tmp_path / "check"), counters, availableNow=True)
        q.awaitTermination()
        sums = counters.totals()["stamps"]
        assert q.exception() is None and sums["stored"] + sums["failed"] == 4
        assert stored_stamps(spark, str(tmp_path / "out")).count() == sums["stored"]
    finally:
        spark.streams.removeListener(counters)


def test_listener_sums_batches_and_failures(spark, tmp_path):
    import time

    counters = Counters()
    spark.streams.addListener(counters)
    try:
        rows = spark.range(40).selectExpr("CASE WHEN id % 2 = 0 THEN 'manifest' ELSE 'entry' END AS kind", "CASE WHEN id % 2 = 0 THEN 3L END AS entry_count", "id")
        for i in range(3):
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        observe_seals(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
        bad = stream.select(F.raise_error(F.concat(F.lit("bad"), F.col("kind"))))
        with pytest.raises(Exception, match="bad"):
            bad.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(60):
            t = counters.totals()
            if t["queries"].get("failed") and t["queries"].get("ended") and t.get("seals", {}).get("entries") == 60:
                break
            time.sleep(0.5)
        assert t["seals"] == {"entries": 60, "segments_sealed": 60, "entries_sealed": 180}
        # the end of a query that ran before may come late
        assert t["queries"]["failed"] == 1 and t["queries"]["ended"] >= 1 and t["queries"]["started"] == 2 and t["queries"]["input_rows"] >= 120
    finally:
        spark.streams.removeListener(counters)


def test_decisions_of_a_batch(spark):
    seen = Observation()
    df = spark.createDataFrame([("ALLOW",), ("DENY",), ("DENY",), (None,)], "decision string")
    assert observe_decisions(df, seen).count() == 4
    assert seen.get == {"requests": 4, "allow": 1, "review": 0, "deny": 2, "rejected": 1}
    empty = Observation()
    assert observe_decisions(df.limit(0), empty).count() == 0 and set(empty.get.values()) == {0}
