import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sealwright.functions.sqlfunctions import register_sql_functions
from sealwright.functions.validators import iban, luhn, pesel
from sealwright.operators import merkle, segments, sweep


def plain_path(leaves, i):
    path, level = [], leaves
    while len(level) > 1:
        if i ^ 1 < len(level):
            path.append(level[i ^ 1].hex())
        up = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level, i = up + level[2 * len(up) :], i // 2
    return path, level[0].hex()


def trees(spark, sizes):
    rows = [(n, i, hashlib.sha256(f"{n}-{i}".encode()).digest()) for n in sizes for i in range(n)]
    return rows, spark.createDataFrame(rows, "t int, i long, leaf binary")


@pytest.mark.parametrize("at_once", [1, 2, 9])
def test_deep_proofs(spark, at_once):
    rows, df = trees(spark, [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33])
    got = merkle.deep_proofs(df, ["t"], "i", levels_at_once=at_once).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {n: [x[2] for x in rows if x[0] == n] for n in {r[0] for r in rows}}
    for r in got:
        path, root = plain_path(by[r.t], r.leaf_index)
        assert (r.audit_path, r.merkle_root, r.tree_size, bytes(r.leaf)) == (path, root, r.t, by[r.t][r.leaf_index])


def test_deep_proofs_of_one_long_log(spark):
    leaves = spark.range(70_001).select(F.lit("log").alias("log_id"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    got = merkle.deep_proofs(leaves, ["log_id"], "id").agg(F.count("*").alias("n"), F.count_if("verified").alias("ok"), F.max(F.size("audit_path")).alias("deepest"), F.countDistinct("merkle_root").alias("roots"), F.first("merkle_root").alias("root")).first()
    assert (got.n, got.ok, got.deepest, got.roots) == (70_001, 70_001, 17, 1)
    assert got.root == merkle.deep_roots(leaves, ["log_id"], "id").first().merkle_root
    assert merkle.deep_proofs(leaves.limit(0), ["log_id"], "id").count() == 0


def test_table_function(spark):
    register_sql_functions(spark)
    rows, df = trees(spark, [1, 2, 5, 12])
    df.withColumn("note", F.lit("n")).createOrReplaceTempView("leaves_of_trees")
    got = spark.sql("SELECT * FROM audit_path(TABLE(leaves_of_trees) PARTITION BY t ORDER BY i)").collect()
    by = {n: [x[2] for x in rows if x[0] == n] for n in {r[0] for r in rows}}
    assert sorted((r.t, r.i) for r in got) == [(n, i) for n in sorted(by) for i in range(n)]
    assert all((r.audit_path, r.leaf_index, r.tree_size, r.note) == (plain_path(by[r.t], r.i)[0], r.i, r.t, "n") for r in got)
    for bad in ("SELECT t, i FROM leaves_of_trees", "SELECT *, 1 AS tree_size FROM leaves_of_trees", "SELECT t, 'x' AS leaf FROM leaves_of_trees"):
        with pytest.raises(Exception, match="audit_path"):
            spark.sql(f"SELECT * FROM audit_path(TABLE({bad}) PARTITION BY t)").collect()
    with pytest.raises(Exception, match="null"):
        spark.sql("SELECT * FROM audit_path(TABLE(SELECT CAST(NULL AS BINARY) AS leaf, 1 AS t) PARTITION BY t)").collect()


def test_sql_functions_say_what_columns_say(spark):
    register_sql_functions(spark)
    rnd = random.Random(4)
    texts = ["4111 1111 1111 1111", "44051401359", "PL61 1090 1014 0000 0712 1981 2874", "pl61109010140000071219812874", "DE89370400440532013000", "", None, "é" * 20, "00000000000", "44131401359"]
    texts += ["".join(rnd.choice("0123456789 -AP") for _ in range(rnd.randint(8, 30))) for _ in range(400)] + ["".join(rnd.choice("0123456789") for _ in range(11)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    df.createOrReplaceTempView("texts_to_check")
    sql = spark.sql("SELECT x, luhn_ok(x) AS a, pesel_ok(x) AS b, iban_ok(x) AS c FROM texts_to_check")
    columns = df.select("x", luhn(F.col("x")).alias("a"), pesel(F.col("x")).alias("b"), iban(F.col("x")).alias("c"))
    key = lambda r: (r.x or "", r.x is None, tuple(r[1:]))
    got = sorted(sql.collect(), key=key)
    assert got == sorted(columns.collect(), key=key) and {r.b for r in got} == {r.c for r in got} == {r.a for r in got} == {True, False}
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in sql._jdf.queryExecution().executedPlan().toString()]


def test_sql_paths(spark):
    register_sql_functions(spark)
    _, df = trees(spark, [1, 2, 3, 7, 10])
    p = merkle.deep_proofs(df, ["t"], "i")
    p.createOrReplaceTempView("paths_to_check")
    ask = lambda **a: {r[0] for r in spark.sql("SELECT verify_audit_path({leaf}, {i}, {n}, {path}, {root}) FROM paths_to_check WHERE tree_size > 1".format(**({"leaf": "leaf", "i": "leaf_index", "n": "tree_size", "path": "audit_path", "root": "merkle_root"} | a))).collect()}
    assert ask() == {True}
    for a in ({"i": "tree_size"}, {"i": "-1L"}, {"path": "array_append(audit_path, repeat('0', 64))"}, {"path": "slice(audit_path, 2, 9)"}, {"root": "repeat('a', 64)"}, {"leaf": "X'00'"}, {"path": "CAST(NULL AS ARRAY<STRING>)"}, {"n": "0L"}, {"root": "CAST(NULL AS STRING)"}):
        assert ask(**a) == {False}, a


def test_first_owner_and_carry(spark):
    rnd = random.Random(9)
    spans = [(k, i, a, a + rnd.randint(-2, 30)) for k in "ab" for i, a in enumerate(rnd.choices(range(300), k=40))]
    spans += [("a", 99, 0, 299), ("b", -1, 50, 50), ("b", 7, 50, 50), ("c", 5, 10, 20), (None, 1, 0, 9), ("c", None, 0, 9)]
    points = [(k, p, f"x{p}") for k in ("a", "b", "c", "d", None) for p in range(0, 310)] + [("a", 5, "twice")] * 2
    df = spark.createDataFrame(spans, "k string, who long, low long, high long")
    pieces = sweep.first_owners(df, "k", "low", "high", "who")
    low = {}
    for k, who, a, b in spans:
        if k is not None and who is not None:
            for p in range(a, b + 1):
                low[k, p] = min(who, low.get((k, p), 1 << 60))
    cut = sorted(tuple(r) for r in pieces.collect())
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(cut, cut[1:]))
    assert not [1 for x, y in zip(cut, cut[1:]) if x[0] == y[0] and x[2] + 1 == y[1] and x[3] == y[3]]
    for bits in (3, 16):
        got = sweep.carried(spark.createDataFrame(points, "k string, p long, row string").repartition(5), pieces, "k", "p", "low", "high", "who", bits).collect()
        assert sorted(map(tuple, got)) == sorted((k, p, r, low[k, p]) for k, p, r in points if (k, p) in low)
        every = sweep.binned(spark.createDataFrame(points, "k string, p long, row string"), df.where("low <= high"), "k", "p", "low", "high", bits)
        assert sorted((r.k, r.p, r.row, r.who or -5) for r in every.collect()) == sorted((k, p, r, who or -5) for k, p, r in points for q, who, a, b in spans if k is not None and q == k and a <= p <= b)


def test_forged_ranges_cost_nothing(spark):
    entries = spark.range(5000).select(F.lit("l").alias("log_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("chain_hash"))
    found = spark.createDataFrame([("l", i, 0, 1 << 62) for i in range(2, 300)] + [("l", 1, 4990, 6000), ("x", 1, 0, 5)], "log_id string, segment_id long, first_seq long, last_seq long")
    got = segments.covering(entries, found).groupBy("segment_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 10), (2, 4990)]
