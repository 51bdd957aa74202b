import math
import re
from collections import Counter, defaultdict

import pytest

from sealwright.llm.mixing import mix, mix_rows, solve
from sealwright.llm.queries import op2_mixing


def weights(bins, a):
    z = sum(n * s**a for s, n in bins)
    return [s**a / z for s, n in bins for _ in range(n)]


def test_exponent_meets_targets():
    bins = [(0.5, 1), (0.2, 2), (0.01, 10)]
    full = -sum(w * math.log(w) for w in weights(bins, 1))
    for target in (full + 0.2, full + 0.4):
        m = solve(bins, 1000, 1000, target_entropy=target)
        assert abs(-sum(w * math.log(w) for w in weights(bins, m.exponent)) - target) < 1e-6
    assert solve(bins, 1000, 1000, target_entropy=0.1).exponent == 1 and solve(bins, 1000, 1000, target_entropy=9).exponent < 1e-9
    for limit in (1.5, 3.0):
        m = solve(bins, 1000, 1000, max_repeats=limit)
        assert abs(max(w / s for w, s in zip(weights(bins, m.exponent), weights(bins, 1))) - limit) < 1e-6
    assert solve(bins, 1000, 1000, max_repeats=1e9).exponent == 0
    m = solve(bins, 1000, None, max_repeats=2)
    r = [w * m.budget / (s * 1000) for w, s in zip(weights(bins, m.exponent), weights(bins, 1))]
    assert min(r) == pytest.approx(1) and max(r) == pytest.approx(2)
    assert solve([], 0).budget == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 50), ["hot", "a", "b", None, "hot", "hot"][i % 6], "x", 5) for i in range(3000)] + [(9001, None, "none", "x", 1), (9002, "", "none", "x", 1), (None, "q q", "a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string, pass int").repartition(4)


@pytest.mark.parametrize("how", [dict(budget=40_000.0, max_repeats=2.0), dict(budget=90_000.0, target_entropy=1.3), dict(max_repeats=1.7)])
def test_realised_weights(spark, docs, how):
    own, count = Counter(), Counter()
    for r in docs.collect():
        k = "null" if r.source is None else "=" + r.source
        own[k] += len((r.text or "").split())
    rows = mix_rows(docs, blocks=16, **how).collect()
    total = sum(own.values())
    m = solve([(v / total, 1) for v in own.values() if v], total, how.get("budget"), how.get("target_entropy"), how.get("max_repeats"))
    got = Counter()
    seen = defaultdict(Counter)
    for r in rows:
        got[r.source_key] += r.tokens
        seen[r.source_key][r.doc_id] += 1
        assert 0 <= r.position < 1
    for k, v in own.items():
        if v:
            quota = m.budget * (v / total) ** m.exponent / m.normaliser
            assert quota - 60 < got[k] <= quota + 1
            per = set(seen[k].values())
            assert max(per) <= math.ceil(quota / v + 1e-6) and max(per) - min(per) <= 1
        else:
            assert set(seen[k].values()) == {1}
    taken = mix(docs, blocks=16, **how)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == Counter(r.doc_id for r in rows)
    order = sorted((r.position, r.source_key, r.tokens) for r in rows if r.tokens)
    half = sum(x[2] for x in order) / 2
    run, part = 0, Counter()
    for _, k, t in order:
        run += t
        part[k] += t
        if run >= half:
            break
    assert all(abs(part[k] / run - got[k] / (2 * half)) < 0.06 for k in got)


def test_empty_and_query(spark, docs):
    assert mix_rows(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    got = op2_mixing(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    ids = {r.doc_id for r in rows}
    docs_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    own, longest, of = Counter(), Counter(), {}
    for r in docs_:  # weights and budget by hand, from the query's own parameters
        k, n = "null" if r.source is None else "=" + r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        own[k] += n
        longest[k] = max(longest[k], n)
        of[r.doc_id] = (k, n)
    total = sum(own.values())
    m = solve([(v / total, 1) for v in own.values()], total, None, None, 1.5)
    taken = Counter()
    for r in rows:
        assert (r.source_key, r.tokens) == of[r.doc_id]
        taken[r.source_key] += r.tokens
    for k, v in own.items():
        quota = m.budget * (v / total) ** m.exponent / m.normaliser
        assert max(v, quota - longest[k]) <= taken[k] + 1 and taken[k] <= max(v, quota) + 1 and quota <= 1.5 * v * (1 + 1e-6)
    assert ids == {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def test_sources_of_almost_equal_share_stay_whole(spark):
    rows = [(i, "w " * (1001 if i == 0 else 1000), "ab"[i % 2]) for i in range(800)] + [(900 + i, "w " * 50, "c") for i in range(20)]
    near = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert {r.doc_id for r in mix_rows(near, max_repeats=1.5).collect()} == {r[0] for r in rows}


def test_weights_by_hand(docs):
    """Quotas from formulas of their own: with the least budget, shares to a power make the smallest source repeat `limit` times and the largest once."""
    own = Counter()
    for r in docs.collect():
        own["null" if r.source is None else "=" + r.source] += len((r.text or "").split())
    own = {k: v for k, v in own.items() if v}
    low, high = min(own.values()), max(own.values())
    for limit in (1.2, 1.7):
        a = 1 + math.log(limit) / math.log(low / high)
        assert 0 < a < 1
        got = Counter()
        for r in mix_rows(docs, budget=None, max_repeats=limit, blocks=16).collect():
            got[r.source_key] += r.tokens
        for k, v in own.items():
            quota = v * (v / high) ** (a - 1)
            assert quota - 60 < got[k] <= quota * 1.01 + 1, (k, quota, got[k])
    # an entropy target by a search over a grid of exponents
    total = sum(own.values())
    entropy = lambda a: -sum(w * math.log(w) for w in [v**a / sum(x**a for x in own.values()) for v in own.values()])
    target = (entropy(1) + entropy(0)) / 2
    a = min((i / 20_000 for i in range(20_001)), key=lambda x: abs(entropy(x) - target))
    got = Counter()
    for r in mix_rows(docs, budget=2.0 * total, target_entropy=target, blocks=16).collect():
        got[r.source_key] += r.tokens
    for k, v in own.items():
        quota = 2.0 * total * v**a / sum(x**a for x in own.values())
        assert quota * 0.99 - 60 < got[k] <= quota * 1.01 + 1, (k, quota, got[k])
