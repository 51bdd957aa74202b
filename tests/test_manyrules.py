import itertools
import random

import pytest
from pyspark.sql import functions as F

from sealwright.operators import manyrules
from sealwright.operators.decide import evaluate
from sealwright.operators.manyrules import evaluate_many, finder
from sealwright.plans.packs import Pack, Rule, load_packs

COLUMNS = ["id", "policy_set", "policy_hash", "input_hash", "shadow_hash", "violations", "decision"]


def same_as_unrolled(df, packs, **more):
    a, b = evaluate(df, packs, **more).select(*COLUMNS), evaluate_many(df, packs, **more).select(*COLUMNS)
    assert a.schema.simpleString() == b.schema.simpleString()
    rows = sorted(b.collect(), key=lambda r: r.id)
    assert rows == sorted(a.collect(), key=lambda r: r.id)
    return rows


def test_shipped_packs_give_the_same_rows(spark):
    rnd = random.Random(1)
    bits = ["Card 4111-1111-1111-1111", "4111-1111-1111-1112", "PL61109010140000071219812874", "DE89370400440532013000", "Code DEUTDEFF", "А​EUTDEFF", "44051401359", "diagnosis", "kardiolog", "25 mg", "3 µg", "too  old", "w ciazy", "niepełnosprawny", "ınvalid", "Kalek", "ok", ""]
    contexts = ["Finance Bot", "finance", "MedTech", "HR", ""]
    rows = [(i, rnd.choice(contexts), " ".join(rnd.choices(bits, k=3)), rnd.choice(bits), rnd.choice(["finance-v1", "medtech-v1", "hr-bias-v1", None, "none"])) for i in range(600)]
    rows += [(1000, None, "diagnosis", "ok", "medtech-v1"), (1001, "x", None, "ok", "hr-bias-v1")]
    got = same_as_unrolled(spark.createDataFrame(rows, "id long, context string, prompt string, response string, policy_set string"), load_packs())
    assert {r.decision for r in got} == {"ALLOW", "DENY", "REVIEW", None} and {v.validator for r in got for v in r.violations or []} == {"luhn", "pesel", "iban", None}


def test_many_rules(spark):
    rnd = random.Random(2)
    words = ["".join(x) for x in itertools.product("abc", repeat=4)]
    rules = [Rule(f"r{i}", rnd.choice([rf"\b{w}\b", rf"{w[:2]}\s+{w[2:]}", rf"(?:{w}|{w[::-1]})x?", rf"[{w}]{{4}}z", rf"(?-i){w.upper()}", rf"{w}(?:\d|é)"]), rnd.choice(["deny", "review", "note"]), 0.5, None, rnd.choice([None, None, "Bot", "^x"])) for i, w in enumerate(words)]
    packs = {"many": Pack("many", "1", "h", tuple(rules)), "none": Pack("none", "1", "g", ())}
    rows = [(i, rnd.choice(["Bot", "x", ""]), " ".join(rnd.choices(words + ["z", "é", "7"], k=6)), "", rnd.choice(["many", "many", "none", "other"])) for i in range(200)]
    got = same_as_unrolled(spark.createDataFrame(rows, "id long, context string, prompt string, response string, policy_set string"), packs, default="many")
    assert max(len(r.violations or []) for r in got) > 3


def test_finder(monkeypatch):
    keys = [frozenset(["abc", "bcd"]), None, frozenset(["b"]), frozenset(["\x00q"]), frozenset(["abc"])]
    want = {"ABCD": [0, 1, 2, 4], "xyz": [1], "": [1], "a\x00Qb": [1, 2, 3], "BCD": [0, 1, 2]}
    assert {t: finder(keys)(t) for t in want} == want and finder([])("a") == [] and finder([None])("") == [0]
    monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    assert {t: finder(keys)(t) for t in want} == want and finder([])("a") == []


def test_rules_are_bounded(monkeypatch):
    monkeypatch.setattr(manyrules, "MOST_RULE_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        manyrules.candidates({"p": Pack("p", "1", "h", (Rule("r", "abc", "deny", 1.0),))}, F.lit("p"), F.lit("x"))


def test_words_are_decided_by_their_neighbours(spark, monkeypatch):
    """Java tries a word's pattern only where a character beside it isn't ASCII; the rows are those of all patterns tried."""
    rules = tuple(Rule(w, rf"\b{w}\b", "review", 0.1, None, g) for w, g in (("ask", None), ("as", None), ("a_1", None), ("Sky", "x"), ("k", None)))
    texts = ["ask", "asks ask", "tasks", "as-k", "asé", "éas", "aś", "́as", "aſk", "K", "a_1.", "a_12 xa_1", "SKY", "sky2", "", "ask\nas", "\U0001d400as", "as​"]
    rows = [(i, "Bot" if i % 2 else "x", t, "", "p") for i, t in enumerate([*texts, *(f"é {t}" for t in texts), *(f"{t} as" for t in texts)])]
    df = spark.createDataFrame(rows, "id long, context string, prompt string, response string, policy_set string")
    got = same_as_unrolled(df, {"p": Pack("p", "1", "h", rules)})
    assert {v.rule for r in got for v in r.violations} == {"ask", "as", "a_1", "Sky", "k"}
    for absent in (False, True):
        if absent:
            monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
        find = manyrules._placed([frozenset()] * 2, ["ask", "as"])
        assert [find(t) for t in ("ask as", "tasks", "asé ask", "aśk as", "aſk")] == [{0: True, 1: True}, {}, {1: False, 0: True}, {1: True}, {0: False, 1: False}]
