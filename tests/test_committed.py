import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from sealwright.model import ENTRY
from sealwright.operators import chain
from sealwright.sources.committed import FORMAT, AuditLogs, LogDataWriter, Staged


def rows(spark, n, logs=("a", "b/ü"), start=0):
    d = spark.range(start, start + n).select(F.explode(F.array(*map(F.lit, logs))).alias("log_id"), F.col("id").alias("at"))
    text = lambda name: F.concat(F.lit(name), F.col("at").cast("string")).alias(name)
    names = ["audit_id", "timestamp", "policy_set", "policy_hash", "context", "input_hash", "shadow_hash"]
    hit = F.array(F.struct(F.lit("r").alias("rule"), F.lit("deny").alias("action"), F.lit(0.5).cast("float").alias("confidence"), F.lit(None).cast("string").alias("validator")))
    return d.select("log_id", "at", F.lit("audit.v1").alias("schema"), F.lit("DENY\n\"é").alias("decision"), *map(text, names), hit.cast(ENTRY["violations"].dataType).alias("violations"))


def numbered(spark, n, seq, **more):
    return chain.build_chain(rows(spark, n, **more).withColumn("seq", F.col("at") + seq))


def test_appends_go_on_from_each_other(spark, tmp_path):
    logs = AuditLogs(spark, str(tmp_path / "x"))
    assert logs.heads().count() == logs.read().count() == 0
    logs.append(rows(spark, 0), ["at"])
    assert logs.heads().count() == 0
    logs.append(rows(spark, 5), ["at"])
    logs.append(rows(spark, 3, start=5, logs=("a", "new")), ["at"])
    got = logs.read()
    assert sorted((r.log_id, r.next_seq) for r in logs.heads().collect()) == [("a", 8), ("b/ü", 5), ("new", 3)]
    assert {r.status for r in chain.verify_chain(got).collect()} == {"OK"} and got.count() == 16
    assert sorted(map(tuple, chain.heads(got).collect())) == sorted(map(tuple, logs.heads().collect()))
    one = got.where("log_id = 'a' AND seq = 7").first()
    assert one.audit_id == "audit_id7" and one.decision == 'DENY\n"é' and one.violations[0].confidence == 0.5


def test_killed_write_leaves_no_entry(spark, tmp_path):
    logs = AuditLogs(spark, str(tmp_path))
    logs.append(rows(spark, 4), ["at"])
    before = sorted(map(tuple, logs.heads().collect()))
    half = numbered(spark, 6, 0).withColumn("context", F.when(F.col("seq") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("context")))
    with pytest.raises(Exception, match="lost"):
        logs.write(half)
    # a writer that dies between its tasks and its commit leaves files that no commit names
    w = LogDataWriter(str(tmp_path), "0" * 64)
    left = w.write(iter(numbered(spark, 2, 0, logs=("a",)).orderBy("seq").collect()))
    assert len(glob.glob(str(tmp_path / "a" / "*.jsonl"))) == 2 and logs.read().count() == 8
    assert sorted(map(tuple, logs.heads().collect())) == before
    logs.append(rows(spark, 2, start=4), ["at"])
    assert logs.read().count() == 12 and {r.status for r in chain.verify_chain(logs.read()).collect()} == {"OK"}
    w.abort([left, None])
    assert logs.read().count() == 12 and not os.path.exists(left.runs[0].file)


def test_stale_writers_fail_and_others_do_not(spark, tmp_path):
    logs = AuditLogs(spark, str(tmp_path))
    logs.append(rows(spark, 3), ["at"])
    heads = spark.createDataFrame(logs.heads().collect())
    late = chain.build_chain(rows(spark, 2, logs=("a",), start=3).withColumn("seq", F.col("at")), heads=heads)
    logs.append(rows(spark, 1, logs=("b/ü",), start=3), ["at"])
    logs.write(late)  # another log has moved: no harm
    with pytest.raises(Exception, match="goes on with entry 5"):
        logs.write(late)
    with pytest.raises(Exception, match="goes on with entry 5"):
        logs.write(numbered(spark, 2, 5, logs=("a",)))  # right number, wrong link
    assert logs.read().count() == 9 and len(glob.glob(str(tmp_path / "a" / "*.jsonl"))) == 2
    assert {r.status for r in chain.verify_chain(logs.read()).collect()} == {"OK"}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    entries = {n: [r for r in numbered(spark, 2, 0, logs=("a", "b")).orderBy("log_id", "seq").collect() if r.log_id == n] for n in "ab"}
    a, same, b = (LogDataWriter(folder, chain.AUDIT_GENESIS) for _ in range(3))
    staged = [a.write(iter(entries["a"])), same.write(iter(entries["a"])), b.write(iter(entries["b"]))]
    create = LogDataWriter._create

    def raced(self, number, body):
        if self is not b and not raced.done:
            raced.done = True
            b.commit([staged[2]])
        return create(self, number, body)

    raced.done = False
    monkeypatch.setattr(LogDataWriter, "_create", raced)
    a.commit([staged[0], None])  # b took version 0 meanwhile: a's turn is 1
    with pytest.raises(Exception, match="goes on"):
        same.commit([staged[1]])
    assert sorted(os.listdir(tmp_path / "_commits")) == [f"{i:020d}.json" for i in (0, 1)]
    assert json.loads((tmp_path / "_commits" / f"{1:020d}.json").read_text())["heads"]["a"]["next_seq"] == 2
    a.commit([Staged()])
    assert len(os.listdir(tmp_path / "_commits")) == 2


def test_what_is_refused(spark, tmp_path):
    logs = AuditLogs(spark, str(tmp_path))
    good = numbered(spark, 3, 0, logs=("a",))
    for bad, what in ((good.withColumn("prev_hash", F.lit("x")), "link"), (good.withColumn("context", F.lit(None).cast("string")), "lacks context"), (good.where("seq <> 1"), "goes on with entry 1")):
        with pytest.raises(Exception, match=what):
            logs.write(bad)
    with pytest.raises(Exception, match="only appended"):
        good.write.format(FORMAT).mode("overwrite").option("path", str(tmp_path)).save()
    with pytest.raises(Exception, match="lack"):
        good.drop("context").write.format(FORMAT).mode("append").option("path", str(tmp_path)).save()
    with pytest.raises(ValueError, match="mounted"):
        AuditLogs(spark, "s3://x/y")
    assert logs.read().count() == 0 and not glob.glob(str(tmp_path / "a" / "*.jsonl"))


def test_appends_shuffle_once(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(AuditLogs, "_commit", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()))
    AuditLogs(spark, str(tmp_path)).append(rows(spark, 3), ["at"])
    assert [p.count("RepartitionByExpression") for p in plans] == [1]
