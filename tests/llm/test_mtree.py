import numpy as np
from oracle import same

from sealwright.llm.mtree import build, search, top_products
from sealwright.llm.queries import OP5_SQL, op5_mtree


def brute(x, ids, q, k, own):
    s = sorted(((-int(v @ q), i) for v, i in zip(x, ids) if i != own))[:k]
    return [(-a, b) for a, b in s]


def test_tree_equals_scan_and_prunes():
    rng = np.random.default_rng(0)
    centers = rng.integers(-3000, 3000, (20, 8))
    x = (centers[rng.integers(0, 20, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(float)
    x[:500] = x[0]
    ids = rng.permutation(4000)
    root = build(x, ids, page=32, fanout=6)
    looked = 0
    for j in range(0, 4000, 97):
        got, n = search(root, x[j], 10, int(ids[j]))
        looked += n
        assert got == brute(x, ids, x[j], 10, ids[j])
    assert looked < 0.6 * 4000 * 42
    assert search(build(np.zeros((700, 2)), np.arange(700), page=16), np.zeros(2), 3, 1)[0] == [(0, 0), (0, 2), (0, 3)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0], 1), (100, [0.5, -1.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (200, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in top_products(df, df.where("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 5 * 1024**2), (0, 2, 100, -3 * 512 * 1024), (100, 1, 0, -3 * 512 * 1024), (100, 2, 1, -3 * 512 * 1024), (200, 1, 7, 0)]
    assert top_products(df.limit(0), df.limit(0)).count() == 0


def test_blocks_and_parts_agree(spark):
    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    q = df.where("vec_id % 7 = 0")
    a = sorted(map(tuple, top_products(df, q).collect()))
    b = sorted(map(tuple, top_products(df, q, part_bytes=50_000, block=10).collect()))
    assert a == b and len(a) == q.count() * 10


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(op5_mtree(spark, d), OP5_SQL, d)
