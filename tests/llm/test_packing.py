import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sealwright.llm.packing import pack, place
from sealwright.llm.queries import op6_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def reassemble(rows, texts, room):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = tok.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == room or at & (at - 1) == 0


def test_every_id_once(spark):
    odd = "Σας ΣΑΣ don't I'LL W̊ Ⅷ ª½ 12345 <|endoftext|> x<|startoftext|>y\tc\r\nd \x1c\x1d İ ß ẞ a÷b 日本語 aaaaaa's"
    texts = {1: None, 2: "", 3: odd, 4: "word " * 5000, 5: "a b c", 6: "  \n "} | {i: f"thing {i} of the Erüß, weird$$$ {'ab' * (i % 40)}" for i in range(7, 400)}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string").repartition(3)
    reassemble(pack(df, PATH, room=64, pool_tokens=500).collect(), texts, 64)
    assert pack(df.limit(0), PATH).count() == 0


def test_rows_are_the_same_in_pieces(spark, monkeypatch):
    """Texts of a batch are encoded a piece at a time, so memory doesn't follow the batch."""
    from sealwright.llm import packing

    texts = {i: f"thing {i} of the Erüß, weird$$$ {'ab ' * (i % 40)}" for i in range(200)} | {200: None, 201: "word " * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    whole = pack(df, PATH, room=64, pool_tokens=500).collect()
    monkeypatch.setattr(packing, "TEXT_PIECE", 300)
    assert sorted(pack(df, PATH, room=64, pool_tokens=500).collect()) == sorted(whole)
    reassemble(whole, texts, 64)


def test_encoding_takes_little_beside_a_batch():
    """A piece's words and ids take under 40 MB (18 by 1 MB of text, 70 by 4 MB)."""
    import tracemalloc

    import numpy as np

    from sealwright.llm.packing import TEXT_PIECE
    from sealwright.llm.textbuf import pieces
    from sealwright.llm.wordbpe import WordBpe

    coder = WordBpe(PATH)
    data = np.frombuffer(b"some plain words and then " * (1 << 18), np.uint8)
    off = np.arange(0, len(data) + 1, 26, dtype=np.int64)
    a, b = next(pieces(off, TEXT_PIECE))
    tracemalloc.start()
    ids, upto = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(upto) == b - a + 1 and len(ids) >= 5 * (b - a) and most < 40 << 20


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c")], "doc_id long, text string").coalesce(1)
    rows = pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows) == [(0, 3), (5, 2), (5, 2)] or sum(r.length for r in rows) == 7


@pytest.mark.parametrize("lengths", [[5, 5, 5, 5], [9, 1, 1, 1, 8], [10] * 7 + [3] * 9, [1] * 50])
def test_place_fills_and_balances(lengths):
    n = sum(lengths) // 10
    placed, left = place(lengths, n, 10, 1.0, 0.1)
    filled = defaultdict(int)
    for _, _, take, s in placed:
        filled[s] += take
    assert all(filled[s] == 10 for s in range(n))
    assert sum(x[2] for x in left) == sum(lengths) - 10 * n


def test_query(spark):
    rows = op6_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    reassemble(rows, {r.doc_id: r.text for r in docs}, 4096)
