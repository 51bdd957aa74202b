from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oracle import same

from sealwright.llm.divergence import partner, shares, source_divergence
from sealwright.llm.queries import OP11_SQL, op11_divergence
from sealwright.llm.terms import LETTERS, LETTERS_DIGITS, pieces_of_terms


def brute(rows, min_docs):
    import re

    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        terms = [t for t in df if df[t] >= min_docs]
        n = defaultdict(Counter)
        for _, s, words in mine:
            n[s].update(w for w in words if df[w] >= min_docs)
        whole = sum(n.values(), Counter())
        p = lambda c, t: 1 + int(Fraction(10**9 * (c[t] + 2), sum(c.values()) + 2 * len(terms)))
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in n:
            pairs = [(o, sum(gap(p(n[s], t), p(n[o], t)) for t in terms)) for o in n if o != s]
            best = [(t, gap(p(n[s], t), p(whole, t))) for t in terms if n[s][t] and p(n[s], t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found) if part == "pair" or r < 10]
    return sorted(out)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    same(op11_divergence(spark, d), OP11_SQL, d)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    words = ["Aé", "aé", "b", "c1d", "É", "x" * 300, "日本", "z\u0000q", "A", "ß"]
    rows = [(None if i % 11 == 0 else f"l{i % 2}", None if i % 7 == 0 else f"s{i % 17}", None if i % 13 == 0 else " ".join(rng.choice(words, i % 9))) for i in range(180)]
    rows += [("l0", "s1", "b b b")] * 5 + [("empty", "s1", ""), ("empty", "s2", "one"), ("alone", "s1", "one one")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS bucket", "2 AS seat", "3 AS value", "4 AS rank")
    got = sorted(tuple(r) for r in source_divergence(df, min_docs=3).collect())
    assert got == brute(rows, 3)
    assert ("empty", "s1", "pair", "s2", 0, 1) in got and not [r for r in got if r[0] == "alone" and r[2] == "pair"]
    assert source_divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("seats", [2, 4, 6, 16])
def test_tournament_meets_every_pair_once(spark, seats):
    from pyspark.sql import functions as F

    met = Counter()
    for r in range(seats - 1):
        got = spark.range(seats).select(F.col("id").cast("int").alias("a"), partner(F.col("id").cast("int"), F.lit(seats), r).alias("b")).collect()
        assert {x["b"]: x["a"] for x in got} == {x["a"]: x["b"] for x in got}
        met.update((x["a"], x["b"]) for x in got if x["a"] < x["b"])
    assert met == Counter({(a, b): 1 for a in range(seats) for b in range(a + 1, seats)})


def test_shares_are_exact():
    for count, total, terms in [(0, 0, 1), (5, 5, 1), (10**12 + 7, 3 * 10**12 + 1, 10**7 + 3), (2 * 10**15, 2 * 10**15, 3)]:
        assert shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)
    with pytest.raises(OverflowError):
        shares(np.array([1]), 10**16, 1)


def test_long_texts_are_cut_between_terms():
    text = b"ab1 \xc3\xa9C" * 1_000_000
    for table in (LETTERS, LETTERS_DIGITS):
        assert [w for p in pieces_of_terms(text, table) for w in p] == text.translate(table).split()
    assert [len(p) for p in pieces_of_terms(b"a" * (9 << 20), LETTERS)] == [1]
