import time

import pytest
from pyspark.sql import functions as F

from sealwright.operators import chain, segments
from sealwright.streaming.sealing import SEALED, resume_state, seal_stream

FIELDS = ["decision", "policy_set", "policy_hash", "context", "input_hash", "shadow_hash", "timestamp"]


def entries(spark, n, logs=3, start=0):
    d = spark.range(start * logs, (start + n) * logs).select((F.col("id") % logs).cast("string").alias("log_id"), F.col("id").alias("order_key"))
    return d.select("*", *(F.concat(F.lit(f[0]), F.col("order_key").cast("string")).alias(f) for f in FIELDS))


def batch(rows):
    return chain.build_chain(chain.allocate(rows.drop("flush"), "log_id", ["order_key"]))


def run(spark, folder, source, schema, initial=None, size=4, interval=0, at="t", name="q"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    out = seal_stream(stream, size, interval, at, initial)
    w = out.writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-check")
    if interval:
        return w.trigger(processingTime="200 milliseconds").start()
    w.trigger(availableNow=True).start().awaitTermination()


def manifests(spark, *paths):
    got = spark.read.schema(SEALED).parquet(*paths).where("kind = 'manifest'")
    return sorted((r.log_id, r.segment_id, r.first_seq, r.last_seq, r.merkle_root, r.prev_merkle_root, r.segment_chain_hash, r.head_chain_hash_at_close) for r in got.collect())


def wanted(found):
    return sorted((r.log_id, r.segment_id, r.first_seq, r.last_seq, r.merkle_root, r.prev_merkle_root, r.segment_chain_hash, r.head_chain_hash_at_close) for r in found.collect())


def test_state_lasts_over_batches_and_restarts(spark, tmp_path):
    source = str(tmp_path / "in")
    for start, n in ((0, 3), (3, 6), (9, 1)):
        entries(spark, n, start=start).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in order of their time
    schema = spark.read.parquet(source).schema
    run(spark, tmp_path, source, schema)
    entries(spark, 5, start=10).coalesce(1).write.mode("append").parquet(source)
    run(spark, tmp_path, source, schema)
    c = batch(entries(spark, 15))
    assert manifests(spark, str(tmp_path / "q-out")) == wanted(segments.manifests(c, 4, "t", keep_open=True))
    links = spark.read.schema(SEALED).parquet(str(tmp_path / "q-out")).where("kind = 'entry'").select("log_id", "seq", "prev_hash", "chain_hash")
    assert sorted(links.collect()) == sorted(c.select("log_id", "seq", "prev_hash", "chain_hash").collect())


def test_long_tail_closes_whole_and_rows_flush(spark, tmp_path):
    c = batch(entries(spark, 9))
    first = segments.manifests(c.where("seq < 2"), 2, "t")
    state = resume_state(c, first)
    assert {len(r.leaves) for r in state.collect()} == {7}
    rest = entries(spark, 3, start=9).withColumn("flush", F.lit(False))
    ends = rest.select("log_id").distinct().withColumn("flush", F.lit(True))
    source = str(tmp_path / "in")
    rest.unionByName(ends, allowMissingColumns=True).coalesce(1).write.parquet(source)
    run(spark, tmp_path, source, spark.read.parquet(source).schema, state)
    got = manifests(spark, str(tmp_path / "q-out"))
    assert {(g[1], g[2], g[3]) for g in got} == {(2, 2, 9), (3, 10, 11)} and len(got) == 6
    done = spark.read.schema(SEALED).parquet(str(tmp_path / "q-out")).where("kind = 'manifest'").drop("kind", "seq", "prev_hash", "chain_hash").withColumn("tst_path", F.lit(None).cast("string"))
    both = first.unionByName(done)
    assert {r.status for r in segments.verify_segment_chain(both).collect()} == {"OK"}
    whole = batch(entries(spark, 12)).withColumn("pos", F.col("seq"))
    assert {r.status for r in segments.verify_against_log(both, whole).collect()} == {"OK"}


def test_logs_without_manifests_resume_too(spark):
    c = batch(entries(spark, 3))
    none = segments.manifests(c.limit(0), 2, "t")
    got = resume_state(c, none).collect()
    assert {(r.next_seq, r.segment_id, len(r.leaves)) for r in got} == {(3, 0, 3)}
    assert resume_state(c.limit(0), none).count() == 0


def test_timer_closes_segments_without_new_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    entries(spark, 2).coalesce(1).write.parquet(source)
    q = run(spark, tmp_path, source, spark.read.parquet(source).schema, size=100, interval=1, at="", name="timed")
    try:
        for _ in range(120):
            time.sleep(0.5)
            try:
                got = manifests(spark, str(tmp_path / "timed-out"))
            except Exception:
                got = []
            if len(got) == 3:
                break
    finally:
        q.stop()
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(str(i), 1, 0, 1) for i in range(3)]


def test_manifests_need_a_time(spark):
    with pytest.raises(ValueError, match="time"):
        seal_stream(entries(spark, 1), 2)


def test_arrivals_come_in_order_and_in_bounded_batches(spark, tmp_path):
    from sealwright.streaming.sealing import write_arrivals

    rows = entries(spark, 400).withColumn("flush", F.lit(False))
    ends = rows.select("log_id").distinct().withColumn("flush", F.lit(True))
    all_rows = rows.repartition(7).unionByName(ends, allowMissingColumns=True)
    source = str(tmp_path / "in")
    assert write_arrivals(all_rows, source, ["flush", "order_key"], most=200) == 7
    stream = spark.readStream.schema(all_rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = seal_stream(stream, 7, 0, "t").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    assert len(sizes) >= 6 and max(sizes) < 400
    assert manifests(spark, f"{tmp_path}/out") == wanted(segments.manifests(batch(entries(spark, 400)), 7, "t"))


def test_queries_seal_backlogs_in_bounded_batches(spark, monkeypatch):
    """With a bound of 300 rows the query's 1,000 events take several batches, and its manifests are the same."""
    from sealwright import queries
    from sealwright.streaming import sealing

    usual = sorted(map(tuple, queries.j5_stream_seal(spark, "/root/testdata/sf0.001").collect()))
    stated = sorted(map(tuple, queries.j_state_resume(spark, "/root/testdata/sf0.001").collect()))
    seen, write = [], sealing.write_arrivals
    monkeypatch.setattr(queries, "write_arrivals", lambda rows, path, order: seen.append(write(rows, path, order, 300)) or seen[-1])
    assert sorted(map(tuple, queries.j5_stream_seal(spark, "/root/testdata/sf0.001").collect())) == usual
    assert sorted(map(tuple, queries.j_state_resume(spark, "/root/testdata/sf0.001").collect())) == stated
    assert len(seen) == 3 and min(seen) > 1
