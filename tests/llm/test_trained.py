import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sealwright.llm.learn import fold, labelled_rows
from sealwright.llm.quality import features, fit_pairs, keep_best, score_quality, train_quality
from sealwright.llm.queries import op1_toxicity, op8_quality, toxicity_model
from sealwright.llm.textbuf import buffers
from sealwright.llm.toxicity import NEAR, SLOTS, Chain, doc_features, emissions, expected, fit, read_words, score_toxicity, train


def brute_marginals(chain, emit, bounds):
    out = []
    for a, b in bounds:
        total, toxic = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            s = chain.start[tags[0]] + sum(chain.trans[x, y] for x, y in zip(tags, tags[1:])) + sum((emit[a + i] + chain.bias) * t for i, t in enumerate(tags))
            total += np.exp(s)
            toxic += np.exp(s) * np.array(tags)
        out.append(toxic / total)
    return np.concatenate(out)


def test_forward_backward_is_exact(monkeypatch):
    from sealwright.llm import toxicity

    rng = np.random.default_rng(0)
    sizes = [1, 7, 3, 10, 2, 9, 5, 4]
    first = np.cumsum([0, *sizes])
    emit = rng.normal(0, 2, first[-1])
    chain = Chain(rng.normal(size=2), rng.normal(size=(2, 2)), 0.3)
    want = brute_marginals(chain, emit, list(zip(first, first[1:])))
    for row in (4, 1024):
        monkeypatch.setattr(toxicity, "_ROW", row)
        assert np.allclose(chain.marginals(emit, first[:-1]), want)


def test_expected_tags_and_all_clean():
    rng = np.random.default_rng(5)
    sizes = [1, 6, 3, 8]
    first = np.cumsum([0, *sizes])
    emit = rng.normal(-1, 2, first[-1])
    chain = Chain(rng.normal(size=2), rng.normal(size=(2, 2)), 0.0)
    post, joint, clean = expected(chain, emit, first)
    for d, (a, b) in enumerate(zip(first, first[1:])):
        total = none = 0.0
        pairs = np.zeros((4, b - a))
        for tags in itertools.product((0, 1), repeat=b - a):
            s = np.exp(chain.start[tags[0]] + sum(chain.trans[x, y] for x, y in zip(tags, tags[1:])) + sum(emit[a + i] * t for i, t in enumerate(tags)))
            total += s
            none += s * (not any(tags))
            for i in range(1, b - a):
                pairs[2 * tags[i - 1] + tags[i], i] += s
        assert np.allclose(joint[:, a + 1 : b], pairs[:, 1:] / total) and np.isclose(clean[d], np.log(none / total))
    assert np.allclose(post, brute_marginals(chain, emit, list(zip(first, first[1:]))))


def test_likelihood_rises_and_tags_are_found():
    rng = np.random.default_rng(6)
    vocab = [f"v{i}" for i in range(60)]
    y = np.arange(400) % 5 == 0
    lines = [" ".join([*rng.choice(vocab, 20), *(["vile"] if bad else []), *rng.choice(vocab, 20)]) for bad in y]
    w = read_words(*buffers(pa.array(lines)))

    def likelihood(epochs):
        chain, weights = fit([(w, y.astype(int))], epochs=epochs, least_steps=0)
        post, _, clean = expected(chain, emissions(w, weights), w.first)
        return np.where(y, np.log1p(-np.exp(np.minimum(clean, -1e-12))), clean).sum(), post

    a, _ = likelihood(3)
    b, post = likelihood(120)
    assert a < b and b > -10
    found = np.flatnonzero(post > 0.5)
    raw = " ".join(lines).encode()
    assert len(found) == y.sum() and all(buffers(pa.array(lines))[0].tobytes()[s:e] == b"vile" for s, e in zip(w.starts[found], w.ends[found])) and raw


def slow_score(model, text):
    """A text's score word by word: features one at a time, forward and backward sums in plain loops."""
    own, near = [], []
    for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        w = read_words(*buffers(pa.array([x.decode()])))
        bare = x.decode().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        assert (w.own[0, 0] == SLOTS) == (bare == "") and (w.own[0] < SLOTS).sum() == (0 if not bare else 1 + sum(len(bare.encode()) > k for k in (4, 5, 6)))
        own.append(sum(model.weights[s] for s in w.own[0]))
        near.append((model.weights[w.before[0]], model.weights[w.after[0]]))
    n = len(own)
    e = [own[i] + NEAR * ((near[i - 1][0] if i else 0) + (near[i + 1][1] if i + 1 < n else 0)) for i in range(n)]
    f, b = [None] * n, [np.zeros(2)] * n
    for i in range(n):
        for_tag = [model.chain.start[t] if i == 0 else np.logaddexp(f[i - 1][0] + model.chain.trans[0, t], f[i - 1][1] + model.chain.trans[1, t]) for t in (0, 1)]
        f[i] = np.array([for_tag[0], for_tag[1] + e[i]])
    for i in range(n - 2, -1, -1):
        b[i] = np.array([np.logaddexp(model.chain.trans[t, 0] + b[i + 1][0], model.chain.trans[t, 1] + e[i + 1] + b[i + 1][1]) for t in (0, 1)])
    p = np.array([1 / (1 + np.exp(f[i][0] + b[i][0] - f[i][1] - b[i][1])) for i in range(n)])
    return 1 / (1 + np.exp(-(doc_features(p, np.array([0, n])) @ model.doc_weights)[0]))


def test_toxicity_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity_model(docs, labels)
    got = {r.doc_id: r.score for r in op1_toxicity(spark, d).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - slow_score(model, r.text)) < 1e-6


def test_quality_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = train_quality(docs, spark.read.parquet(f"{d}/labels.parquet"), fold("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in op8_quality(spark, d).collect()}
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    for r in docs.collect():
        raw = (r.text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(low))
        n, size = max(len(w), 1), max(len(raw), 1)
        share = lambda test: np.sqrt(sum(test(b) for b in raw) / size)
        kinds = [lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b > 127, lambda b: (b < 32 and b not in range(9, 14)) or b == 127, lambda b: b == 10]
        kinds += [lambda b, c=c: b == c for c in range(33, 127) if not chr(c).isalnum()]
        x = [np.log1p(len(w)), np.log1p(len(raw)), len(raw) / n / 16, *(np.sqrt(sum(a == b for a, b in zip(w, w[k:])) / n) for k in (1, 2)), *map(share, kinds)]
        z = model.slope * (((np.array(x) - model.mean) / model.scale) @ model.weights) + model.base
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6


def texts(n):
    rng = np.random.default_rng(1)
    clean = [f"w{i}x" for i in range(400)]
    y = np.arange(n) % 4 == 0
    out = []
    for bad in y:
        w = list(rng.choice(clean, 30))
        if bad:
            for p in rng.choice(30, 4, replace=False):
                w[p] = "grobx" + str(rng.integers(50)) + ","
        out.append(" ".join(w))
    return out, y.astype(int)


def test_toxicity_generalises_and_gives_offsets(spark):
    t, y = texts(1200)
    model = train(*buffers(pa.array(t[:900])), y[:900])
    odd = ["", None, "ÄÖ grobxnew, ok grobxnew2 grobx1!", "x" * 300_000 + " grobx3"]
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate(t[900:] + odd)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in score_toxicity(df, model, least=0.2).collect()}
    assert len(got) == 304
    assert [int(got[i].score >= 0.7) for i in range(300)] == y[900:].tolist()
    spans = got[302].spans
    assert [odd[2][s.begin : s.end] for s in spans] == ["grobxnew,", "grobxnew2 grobx1!"] or {odd[2][s.begin : s.end] for s in spans} >= {"grobxnew,"}
    assert 0 <= got[300].score < 0.7 and got[300].score == got[301].score
    assert score_toxicity(df.limit(0), model).count() == 0


def test_texts_are_tagged_in_pieces(monkeypatch):
    """A batch of many texts takes no more memory beside it than a piece of it, and goes back a piece at a time."""
    import tracemalloc

    from sealwright.llm import toxicity

    model = toxicity.ToxicityModel(Chain(np.array([0.0, -3.0]), np.array([[0.0, -3.0], [0.0, -1.0]]), 0.0), np.sin(np.arange(SLOTS + 1.0)), np.array([-1.0, 1.0, 1.0, 0.0]))
    model.weights[SLOTS] = 0
    lines = [" ".join(f"w{i * j % 977}" for j in range(i % 400)) for i in range(1, 4001)] + [None, "", "x" * 200_000]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(range(len(lines)))], ["text", "doc_id"])
    score = model.tag(*buffers(batch.column(0)))[0]
    cut = float(np.median(score)) + 1e-9
    monkeypatch.setattr(toxicity, "PIECE", 1 << 16)
    ids, rows, most = [], 0, 0
    tracemalloc.start()
    for part in toxicity._sift([batch], 0, model, cut):
        ids += part.column(1).to_pylist()
        rows = max(rows, part.num_rows)
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert ids == np.flatnonzero(score < cut).tolist() and 0 < len(ids) < len(lines)
    assert rows < 1000 and most < 24 << 20  # 8 MB; of the whole batch 157 MB


def test_models_without_labels():
    none = train(*buffers(pa.array([], pa.string())), np.zeros(0, int))
    assert none.tag(*buffers(pa.array(["a b"])))[0][0] == 0.5
    assert train(*buffers(pa.array(["a", "b"])), np.zeros(2, int)).tag(*buffers(pa.array(["a b", ""])))[0].max() < 0.1
    assert fit_pairs(np.zeros((0, 3)), np.zeros(0)).slope == 0


def test_sample_is_bounded_and_filtered(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "e") for i in range(40)] + [(3, 1, "e"), (4, 1, "e"), (None, 1, "e"), (5, None, "e")], "doc_id long, quality int, text string")
    got = labelled_rows(docs, labels, "quality", fold("doc_id", 5) != 0, 10).collect()
    assert len(got) == 10 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["text"] == f"t{r['doc_id']}" for r in got)
    assert 4 not in {r["doc_id"] for r in labelled_rows(docs, labels, "quality", fold("doc_id", 5) != 99, 100).collect()}


def test_toxicity_sample_is_bounded_in_bytes_and_the_same_at_any_partitioning(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sealwright.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda data, off, y: seen.append((bytes(data), off.tolist(), y.tolist())))
    t, y = texts(120)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(t)] + [(7, "another text"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    for parts in (1, 5):
        toxicity.train_toxicity(docs.repartition(parts), labels, F.lit(True))
        toxicity.train_toxicity(docs.repartition(parts), labels, F.lit(True), most_bytes=1000)
        toxicity.train_toxicity(docs.repartition(parts), labels, F.lit(True), most_bytes=0)
    assert seen[:3] == seen[3:]
    assert len(seen[0][2]) == 120 and 1 < len(seen[1][2]) < 120 and len(seen[1][0]) <= 1000 and len(seen[2][0]) == 0
    whole = {x.encode() for x in t} | {b"another text", b""}
    assert all(seen[1][0][a:b] in whole for a, b in zip(seen[1][1], seen[1][1][1:]))


@pytest.mark.parametrize("query,label,folds,rest,least", [(op1_toxicity, "toxic", 3, 1, 0.7), (op8_quality, "quality", 5, 0, 0.3)])
def test_held_out_accuracy(spark, query, label, folds, rest, least):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in query(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % folds == rest) and r.predicted == int(r.score >= least) for k, r in got.items())
    held = [(r.label, got[r.doc_id].predicted) for r in spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", f"{label} label").collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "$$$ ### %%% ") * 5) for i in range(60)] + [(None, None), (99, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = train_quality(docs, labels, fold("doc_id", 5) != 0)
    scored = score_quality(docs, model)
    rows = scored.collect()
    assert len(rows) == 62 and all((r.score > 0.5) == bool(r.doc_id % 2) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert keep_best(scored, 0.5).count() >= 31
    assert keep_best(scored.limit(0), 0.5).count() == 0


def test_quality_fits_whole_texts(spark):
    texts = [("good words here " if i % 2 else "$$$ ### %%% ") * (3000 + i) + "end " * (i % 7) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = train_quality(docs, labels, fold("doc_id", 5) != 9)
    assert np.allclose(got.mean, features(*buffers(pa.array(texts))).mean(axis=0))


def test_cut_is_a_quantile_of_all_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    kinds = ["good words here and there ", "$$$ ### %%% ", "short unlike text, never labelled; "]
    rows = [(i, " ".join([kinds[i % 2 if i < 100 else 2]] * int(rng.integers(2, 30))) + str(i)) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op8_quality(spark, str(tmp_path)).collect()
    cut = np.quantile([r.score for r in got], 0.1, method="inverted_cdf")
    assert sum(not r.above_cut for r in got) < 100 <= sum(r.score <= cut + 1e-3 for r in got)
    assert all(r.above_cut == (r.score >= cut) for r in got if abs(r.score - cut) > 1e-3) and 0 < sum(r.doc_id >= 100 and not r.above_cut for r in got)
