import json

from pyspark.sql import functions as F

from sealwright.operators.decide import evaluate
from sealwright.plans.packs import load_packs
from sealwright.sources.requests import audit_requests, parse_requests, read_requests


def body(**more):
    return json.dumps({"context": "Finance Bot", "payload": {"prompt": "Card 4111-1111-1111-1111", "response": "ok"}} | more, ensure_ascii=False)


LINES = [
    (body(), None), (body(policy_set="hr-bias-v1", extra=[1]), None), (body(policy_set=None), None), ("  " + body(context=""), None), (body(context="é\n"), None),
    (body(context=5), "not text: context"), (body(context=None), "not text: context"), (body(policy_set=3), "not text: policy_set"), (body(payload={"prompt": "x"}), "not text: response"),
    (body(payload="x"), "not text: prompt, response"), (body(payload={"prompt": True, "response": ["a"]}), "not text: prompt, response"), ("{}", "not text: context, prompt, response"),
    ("[1]", "not JSON"), ('"x"', "not JSON"), ("null", "not JSON"), ("{", "not JSON"), (body()[:-1], "not JSON"), (body() + "x", "not JSON"), (body() + "]", "not JSON"), (body() + "}", "not JSON"), (body() + "," + body(), "not JSON"), (body() + ',"a":1', "not JSON"), (body() + " \t", None), ('{"context": "a", "context": "b", "payload": {"prompt": "", "response": ""}}', "not JSON"),
    (body(context="x" * 70_000), "too large"), ("y" * 70_000, "too large"),
]


def test_requests_are_checked(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)] + [(99, ""), (98, "  "), (97, None)], "id int, value string")
    got = {r.id: r for r in parse_requests(df).collect()}
    assert {i: r.problem for i, r in got.items()} == {i: p for i, (_, p) in enumerate(LINES)}
    assert (got[4].context, got[0].prompt, got[0].response, got[1].policy_set, got[2].policy_set) == ("é\n", "Card 4111-1111-1111-1111", "ok", "hr-bias-v1", None)
    assert all(got[i][c] is None for i, (_, p) in enumerate(LINES) if p for c in ("context", "prompt", "response", "policy_set"))


def test_batch_and_stream_decide_alike(spark, tmp_path):
    lines = [t for t, _ in LINES] + [body(policy_set="none")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n\n".join(lines) + "\n", encoding="utf-8")
    batch = audit_requests(read_requests(spark, str(tmp_path / "in")), load_packs())
    q = audit_requests(read_requests(spark, str(tmp_path / "in"), stream=True), load_packs()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: repr(r)
    assert sorted(batch.collect(), key=key) == sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key)
    assert {(r.status, r["n"]) for r in batch.groupBy("status").agg(F.count("*").alias("n")).collect()} == {(200, 6), (400, 20), (404, 1)}
    assert not batch.where("status <> 200 AND (decision IS NOT NULL OR violations IS NOT NULL OR input_hash IS NOT NULL)").count()
    rows = spark.createDataFrame([("Finance Bot", None, "Card 4111-1111-1111-1111", "ok")], "context string, policy_set string, prompt string, response string")
    want = evaluate(rows, load_packs()).select("decision", "violations", "policy_hash", "input_hash").first()
    assert want in [tuple(r) for r in batch.where("status = 200").select("decision", "violations", "policy_hash", "input_hash").collect()] and want.decision == "DENY"
