import glob
import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from oracle import same

from sealwright.llm.components import components
from sealwright.llm.queries import OP7_SQL, op7_near_dedup
from sealwright.llm.scratch import shared_dir
from sealwright.llm.setsketch import estimate, merge, near_duplicates, shingle_sets, sketch
from sealwright.llm.textbuf import buffers


def word_sets(texts, k=5):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(texts):
    sets = word_sets(texts)
    inverted, parent = {}, {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    pairs = {p for v in inverted.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


def families(n, seed=0, size=120):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts, i = [], 0
    while len(texts) < n:
        base = list(rng.choice(vocab, size))
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(size))] = str(rng.choice(vocab))
            texts.append((i, " ".join(w).upper() if i % 3 == 0 else "\n".join(w)))
            i += 1
    return texts


@pytest.mark.parametrize("chunk", [512, 4])
def test_matches_brute_force(spark, chunk):
    texts = families(160) + [(900, None), (901, ""), (902, " a  b "), (903, "A\tb"), (904, "b a"), (905, "a b"), (906, "x " * 40), (907, "x " * 70), (908, "   ")]
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, component_id string").repartition(3)
    got = sorted(tuple(r) for r in near_duplicates(df, chunk=chunk).collect())
    assert got == brute(texts)


def test_one_large_group(spark):
    texts = families(150, seed=4, size=100)[:12]
    rng = np.random.default_rng(9)
    base = texts[0][1].lower().split()
    for i in range(100, 400):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(len(w)))] = f"n{rng.integers(10**6)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df, chunk=50).collect()) == brute(texts)


@pytest.mark.parametrize("n", [150, 300])
def test_large_cluster_of_unlike_texts(spark, n):
    """Half of a cluster shares a template but no link: rows grow with it, not with its square."""
    rng = np.random.default_rng(n)
    vocab = [f"w{i}" for i in range(5000)]
    core = list(rng.choice(vocab, 120))
    texts = [(i, " ".join(core + list(rng.choice(vocab, 80)))) for i in range(n)]
    base = core + list(rng.choice(vocab, 80))
    texts += [(1000 + i, " ".join(base[: 190 - i % 5] + [f"x{i}"])) for i in range(n)]
    tail = texts[5][1].split()
    texts += [(3000 + i, " ".join(tail[:-1] + [f"y{i}"])) for i in range(5)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), chunk=20).collect())
    assert got == brute(texts)
    last = lambda name: max(glob.glob(f"{shared_dir(spark)}/{name}-*"), key=os.path.getmtime)
    assert spark.read.parquet(last("across")).count() <= 50 * len(texts)


def test_blocks_of_a_band(spark, monkeypatch):
    from sealwright.llm import setsketch

    monkeypatch.setattr(setsketch, "BLOCK", 7)
    texts = families(160, seed=5)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df, chunk=3).collect()) == brute(texts)


def test_sets_are_made_in_pieces(monkeypatch):
    """A batch of many texts takes no more memory beside it than a piece of it."""
    import tracemalloc

    from sealwright.llm import setsketch

    monkeypatch.setattr(setsketch, "PIECE", 1 << 16)
    texts = [" ".join(f"w{i * j % 977}" for j in range(300)) for i in range(1, 3001)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    seen, most = [], 0
    tracemalloc.start()
    for part, h, at in setsketch._sets_of([batch], 5):
        seen += list(zip(part.column(0).to_pylist(), np.diff(at).tolist()))
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert seen == list(enumerate(np.diff(shingle_sets(*buffers(batch.column(1)))[1]).tolist()))
    assert most < 8 << 20  # of the whole batch: over 30 MB


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (3, 2, 1, False), (3, 2, 1, False), (1, 2, 1, True)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(4000)]
    x = list(rng.choice(vocab, 900))
    texts = [" ".join(x), " ".join(x[:600]), " ".join(x[596:]), " ".join(rng.choice(vocab, 900))]
    h, at = shingle_sets(*buffers(pa.array(texts)))
    r = sketch(h, at)
    assert (merge(r[1], r[2]) == r[0]).all()
    n = np.diff(at)
    got = estimate(r[0], n[0], r[1:], n[1:])
    assert abs(got[0] - n[1] / n[0]) < 0.12 and got[2] < 0.1


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, x) for x in range(2001, 2400)] + [(5000, 5000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == sorted((x, root(x)) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def roots_of(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("piece", [5, 64])
def test_components_in_rounds(spark, piece):
    """More edges than a task joins at once: paths, stars around large and small ids, random ones, loops."""
    rng = np.random.default_rng(piece)
    path = rng.permutation(300) + 1000
    edges = [*zip(path[:-1].tolist(), path[1:].tolist()), *((9000, x) for x in range(5000, 5400)), *((-7, x) for x in range(6000, 6400)), (6001, 5001), (1, 1), (5000, 5000)]
    edges += rng.integers(20000, 20400, (300, 2)).tolist()
    got = components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long").repartition(3), piece=piece)
    assert sorted(map(tuple, got.collect())) == roots_of(edges)


def test_components_take_few_jobs(spark):
    """A long path is joined inside its tasks, not in a dozen jobs for each doubling."""
    edges = [(i, i + 1) for i in range(1000)]
    spark.sparkContext.setJobGroup("path", "")
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("path"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(1001)] and jobs <= 12


def test_query_against_sql(spark):
    same(op7_near_dedup(spark, "/root/testdata/sf0.001"), OP7_SQL, "/root/testdata/sf0.001")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op7_near_dedup(spark, d).collect()) == brute(texts)
