import hashlib
import itertools

import numpy as np
import pyarrow as pa

from sealwright.llm.queries import op9_simhash
from sealwright.llm.simhash import BITS, _terms, fingerprint_with_edits, fingerprints, within_radius
from sealwright.llm.textbuf import U64, buffers, mix


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def brute(rows):
    """rows: (doc_id, text) in order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        k = len(text) // 2
        edited = text[: len(text) - k] + follow[:k]
        a, b, c = (fingerprints(*buffers(pa.array([x]))).tobytes().hex() for x in (text, edited, follow))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, 1 - distance(a, b) / BITS, 1 - distance(a, c) / BITS))
    return out


def test_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = {int(i): " ".join(rng.choice(["the", "Ärger", "of", "zeta", "日本", "a"], int(rng.integers(0, 30)))) for i in rng.permutation(300)}
    texts[5] = None
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, part_ int").repartition(5)
    want = brute([(k, texts[k] or "") for k in sorted(texts)])
    df.write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    for size in (1 << 30, 3000):
        got = sorted(tuple(r) for r in fingerprint_with_edits(df, part_bytes=size).collect())
        assert got == want


def votes(text):
    """The fingerprint bit by bit: every term's weight for or against each bit of its hash."""
    h, weight, _ = _terms(*buffers(pa.array([text])))
    out = 0
    for half in range(BITS // 64):
        for bit in range(64):
            total = sum(w if x >> bit & 1 else -w for x, w in zip(h.tolist(), weight.tolist()))
            out |= (total > 0) << (half * 64 + bit)
        h = mix(h * U64(0x9E3779B97F4A7C15) + U64(half + 1))
    return out.to_bytes(BITS // 8, "little").hex()


def test_votes_of_every_bit():
    texts = ["", "one", "a b", "the cat sat on the mat and the dog", "É é É x" * 9, "w " * 500 + "z"]
    got = fingerprints(*buffers(pa.array(texts)))
    assert [bytes(r).hex() for r in got] == [votes(t) if t else "00" * 16 for t in texts]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op9_simhash(spark, d).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())
    assert got == brute(rows) and all(votes(t) == g[3] for (_, t), g in list(zip(rows, got))[:40])


def test_ranges_cut_finer_than_quantiles(spark, monkeypatch):
    from sealwright.llm import simhash

    monkeypatch.setattr(simhash, "COARSE", 3)
    rows = [(i * i * 7, f"text {i} " * (i % 5 + 1)) for i in range(200)]
    got = sorted(tuple(r) for r in fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), part_bytes=300).collect())
    assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint_with_edits(empty).count() == 0
    one = fingerprint_with_edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in one] == [(7, 4, hashlib.sha256(b"abab").hexdigest())]
    tied = fingerprint_with_edits(spark.createDataFrame([(1, "b b"), (1, "a a"), (None, "c"), (2, "d")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in tied) == [(0, 1), (1, 3), (1, 3), (2, 1)]


def test_radius_tables(spark):
    rng = np.random.default_rng(5)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(20)]
    fps = [x ^ sum(1 << int(b) for b in rng.choice(128, k, replace=False)) for x in base for k in (0, 1, 2, 3, 4)] + base[:3]
    text = [f"{x:032x}" for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(text)] + [(999, None)], "doc_id long, fingerprint string")
    want = {(a, b, distance(a, b)) for a, b in itertools.combinations(sorted(set(text)), 2) if distance(a, b) <= 3}
    assert {tuple(r) for r in within_radius(df, 3).collect()} == want and want
