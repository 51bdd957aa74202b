import hashlib
import os.path

import numpy as np
import pytest
from oracle import same

from sealwright.llm.queries import OP3_SQL, op3_suffix_dedup
from sealwright.llm.repeats import cut_repeats, in_smaller
from sealwright.llm.suffixes import common_prefixes, suffix_array


def brute(rows, width=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - width + 1):
                s = raw[p : p + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        if i is not None:
            for p in range(len(raw) - width + 1):
                if first[raw[p : p + width]] < i:
                    gone[p : p + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        segments = [bytes(rng.integers(1, rng.integers(2, 6), rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        text = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8)
        longest = max(map(len, segments))
        order, raw = suffix_array(text, longest), text.tobytes()
        own = [raw[i : raw.index(b"\0", i)] for i in order.tolist()]
        assert own == sorted(raw[i : raw.index(b"\0", i)] for i in range(len(raw)) if text[i])
        assert common_prefixes(text, order, longest).tolist() == ([0] + [len(os.path.commonprefix([a, b])) for a, b in zip(own, own[1:])] if own else [])


def corpus(n=220):
    rng = np.random.default_rng(8)
    vocab = ["alpha", "Über", "naïve", "delta", "e", "日本", "zz", "the", "of"] + [f"w{i}" for i in range(500)]
    passages = [" ".join(rng.choice(vocab, 25)) for _ in range(6)] + ["x" * 200, "ab" * 90, "License text of some length that repeats in many texts, all the same."]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocab, int(rng.integers(0, 40)))) for _ in range(3)]
        for _ in range(int(rng.integers(0, 3))):
            p = str(rng.choice(passages))
            cut = sorted(rng.integers(0, len(p), 2)) if rng.random() < 0.4 else (0, len(p))
            parts.insert(int(rng.integers(0, 4)), p[cut[0] : cut[1]])
        rows.append((int(i * 3 - 60), " ".join(parts)))
    for i in range(40):  # near and exact copies
        t = list(rows[i][1])
        for _ in range(int(rng.integers(0, 3))):
            if t:
                t[int(rng.integers(len(t)))] = "#"
        rows.append((5000 - i, "".join(t)))
    return rows + [(9000, None), (9001, ""), (9002, "short"), (9003, rows[3][1] * 30), (None, rows[5][1]), (9004, "q" * 49), (9005, "q" * 49), (9006, "é" * 30), (9007, "é" * 31)]


@pytest.mark.parametrize("how", [{}, {"hash_bits": 3}, {"hot_docs": 0}, {"hot_docs": 0, "hash_bits": 0, "part_bytes": 2000}])
def test_matches_brute_force(spark, how):
    rows = corpus()
    order = np.random.default_rng(1).permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], "k") for i in order], "doc_id long, text string, key string").repartition(5)
    got = sorted((tuple(r) for r in cut_repeats(df, **how).collect()), key=repr)
    assert got == brute(rows)


def test_truncated_sort_groups_equal_strings():
    rng = np.random.default_rng(1)
    for width in (3, 8, 11):
        for _ in range(60):
            segments = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
            owner = rng.integers(0, 4, len(segments))
            size = np.array([len(x) for x in segments])
            of, p = in_smaller(np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size, size, owner, width)
            least = {}
            for x, d in zip(segments, owner.tolist()):
                for i in range(len(x) - width + 1):
                    least[x[i : i + width]] = min(d, least.get(x[i : i + width], d))
            want = sorted((j, i) for j, x in enumerate(segments) for i in range(len(x) - width + 1) if least[x[i : i + width]] < owner[j])
            assert sorted(zip(of.tolist(), p.tolist())) == want


def test_equal_hashes_remove_nothing(spark):
    # two texts of one seed whose contexts once had equal hashes
    a, b = "on9bimarnrxhytlo42i6ge1i2jza3kz4whx2usxkspboaho9xw", "ddhmtb9ijffvdtlo42i6ge1i2jza3kz4whx2utoivso1edp76q"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").repartition(2, "doc_id")
    assert {(r.doc_id, r.n_removed) for r in cut_repeats(df).collect()} == {(1, 0), (2, 0)}
    assert {(r.doc_id, r.n_removed) for r in cut_repeats(df, hash_bits=0).collect()} == {(1, 0), (2, 0)}


def test_repeated_rows_and_text(spark):
    p = "a passage of more than fifty bytes that stands in two texts, ends."
    rows = [(1, "x " + p), (1, "x " + p), (2, p + " yé"), (2, p + " yé"), (3, "zz")]
    df = spark.createDataFrame([(t, i, "k") for i, t in rows], "text string, doc_id long, n_bytes string")
    got = cut_repeats(df, with_text=True)
    assert got.columns[:3] == ["text", "doc_id", "n_bytes"]
    assert sorted((r[1], r[0]) for r in got.collect()) == [(1, "x " + p), (1, "x " + p), (2, " yé"), (2, " yé"), (3, "zz")]
    odd = spark.createDataFrame([(1, p), (2, p + "!"), (2, "a" + p)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in cut_repeats(odd).collect()) == [(1, 0), (2, 0), (2, len(p))]
    assert cut_repeats(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    same(op3_suffix_dedup(spark, "/root/testdata/sf0.001"), OP3_SQL, "/root/testdata/sf0.001")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op3_suffix_dedup(spark, d).collect()), key=repr) == brute(rows)
