import math
import re
from collections import Counter

import numpy as np
from oracle import same

from sealwright.llm.queries import OP13_SQL, op13_ranked_search
from sealwright.llm.threshold import Shard, best_of, top_documents


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=10):
    own = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(words(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        score = lambda c, n: sum(asked[t] * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms))) for t in asked if c[t])
        found = sorted(((-score(c, n), i is None, i or 0, i) for i, c, n in own if score(c, n) > 0))[:k]
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(found)]
    return sorted(out, key=repr)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(op13_ranked_search(spark, d), OP13_SQL, d)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    some = ["Aé", "aé", "b2", "2B", "x", "y", "日本", "zz", "B2", "q" * 400]
    docs = [(None if i % 17 == 0 else i // 2, None if i % 23 == 0 else " ".join(rng.choice(some, i % 12)) + ".") for i in range(160)] + [(7, "rare b2")] * 3
    items = [(1, "b2 b2 rare"), (2, ""), (3, None), (4, "nowhere"), (5, "Aé x-y zz"), (5, "Aé x-y zz"), (None, "日本"), (6, "aé " * 50 + "x"), (7, "q" * 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS query", "3 AS score").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank")
    want = brute(docs, [i for i in items if words(i[1])])
    for blocks in ({}, {"block_items": 2}):
        assert sorted((tuple(r) for r in top_documents(d, q, **blocks).collect()), key=repr) == want
    assert top_documents(d.limit(0), q).count() == top_documents(d, q.limit(0)).count() == 0
    assert sorted((tuple(r) for r in top_documents(d, q, k=2).collect()), key=repr) == brute(docs, [i for i in items if words(i[1])], 2)


def test_shards_of_a_task_go_on_from_each_other(spark, monkeypatch):
    from sealwright.llm import threshold

    docs = [(i, " ".join(f"t{(i * j) % 41}" for j in range(1 + i % 30))) for i in range(5000)]
    items = [(i, f"t{i} t{i + 3} t{i * 7 % 41} t1 t0") for i in range(30)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(threshold, "_SHARD_ENTRIES", 9000)
    assert sorted((tuple(r) for r in top_documents(d, q).collect()), key=repr) == brute(docs, items)


def test_search_stops_early_and_misses_nothing():
    rng = np.random.default_rng(2)
    n, v = 20_000, 50
    has = rng.random((n, v)) < 0.2
    doc, term = np.nonzero(has)
    impact = np.where(doc < 30, 999_000, rng.integers(1, 300_000, len(doc)))
    s = Shard(np.arange(n)[::-1].copy(), np.concatenate([[0], np.cumsum(has.sum(1))]), term, impact, v)
    looked = []
    scores = s.scores
    s.scores = lambda docs: looked.append(len(docs)) or scores(docs)
    none = np.zeros(0, np.int64)
    for terms in (np.array([3, 9, 40]), np.array([1]), np.arange(50)):
        w = rng.integers(1, 50, len(terms))
        looked.clear()
        got = s.search(terms, w, 10, (none, none))
        full = np.zeros(n, np.int64)
        full += np.bincount(doc, np.isin(term, terms) * impact * np.bincount(terms, w, v)[term], n).astype(np.int64)
        want = best_of(full, s.ids, 10)
        assert got[0].tolist() == full[want].tolist() and got[1].tolist() == s.ids[want].tolist()
        assert sum(looked) < (n if len(terms) > 3 else n / 10)
