import zlib
from collections import Counter

import numpy as np
import pytest
from test_repeats import brute as brute_repeats
from test_setsketch import brute as brute_near

import corpus_pipeline as cp
from sealwright.llm.queries import op1_toxicity, table, word_tokenizer
from sealwright.llm.scratch import kept

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, D, "documents"), []
    for name, stage in cp.STAGES:
        nxt = kept(stage(spark, docs, D), f"test-{name}")
        out.append((docs.collect(), nxt.collect()))
        if name != cp.STAGES[-1][0]:
            assert nxt.columns == docs.columns
        docs = nxt
    return out


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    toxic = {r.doc_id for r in op1_toxicity(spark, D).collect() if r.predicted}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - toxic


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    want = {i for i, _, _, stays in brute_near([(r.doc_id, r.text) for r in before]) if stays}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_repeats_are_cut(stages):
    before, after = stages[2]
    want = {i: (n, gone) for i, n, gone, _, _ in brute_repeats([(r.doc_id, r.text) for r in before])}
    got = {r.doc_id: r for r in after}
    for r in before:
        n, gone = want[r.doc_id]
        if not gone:
            assert got[r.doc_id] == r
        elif r.doc_id in got:
            assert len(got[r.doc_id].text.encode()) <= n - gone and got[r.doc_id].n_chars == len(got[r.doc_id].text)
        else:
            assert gone > 0


def test_mixture_keeps_all_and_repeats_within_limits(stages):
    before, after = stages[3]
    seen = Counter(r.doc_id for r in after)
    assert set(seen) == {r.doc_id for r in before} and max(seen.values()) <= 2
    assert len(after) > len(before)


def test_packing_holds_every_id(stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    tok = Tokenizer.from_file(word_tokenizer())
    n = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == n
    by = Counter()
    for r in after:
        by[r.sequence_id] += r.length
    assert all(v == 4096 or v & (v - 1) == 0 for v in by.values())
    whole = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4") for r in before}
    for r in after[:200]:
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())


def test_run(spark, stages):
    assert cp.run(spark, D).count() > 0
