"""Rule packs of many rules: a rule's pattern is tried only on texts that hold a literal it can't match without.

One automaton over the literals of all rules reads each text once, in Arrow batches, and hands out the rules that remain; Java's
engine then tries those, in the same projection. Rules without a sure literal are tried on every text. Where a pattern is a word between
word boundaries, the characters beside the literal tell whether it matches, and Java tries it only where these aren't ASCII.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.functions.validators import VALIDATORS
from sealwright.model import VIOLATION
from sealwright.operators.decide import by_pack, decision
from sealwright.functions.hashing import sha256_hex
from sealwright.functions.normalize import original_text, shadow
from sealwright.plans.dialect import literals, parse
from sealwright.plans.packs import Pack, compile_pattern

MOST_RULE_BYTES = 64 << 20
_RULES = "array<struct<rule: string, action: string, confidence: double, validator: string, pattern: string, gate: string>>"
_WORD = re.compile(r"\\b([0-9A-Za-z_]+)\\b")  # patterns whose match its neighbours tell
_IN_WORD = frozenset(string.ascii_letters + string.digits + "_")
# Characters beyond ASCII that a pattern of any case takes for a letter of ASCII.
_ALIKE = {0x17F: "s", 0x212A: "k", 0x131: "i", 0x130: "i"}


def _placed(keys: list[frozenset[str] | None], words: list[str | None]) -> Callable[[str], dict[int, bool]]:
    """A function from a text to the places of all keys of which it holds a literal, and whether the place's word surely matches.

    words: for each key the word whose pattern it stands for, or None. Where all of a word's occurrences have a word's character of ASCII
    beside them, its place isn't among those found.
    """
    always = [i for i, k in enumerate(keys) if k is None]
    by: dict[str, tuple[list[int], list[int]]] = {}
    for i, (k, w) in enumerate(zip(keys, words)):
        for text in (k or ()) if w is None else (w.lower(),):
            by.setdefault(text, ([], []))[w is not None].append(i)
    try:
        import ahocorasick
    except ImportError:

        def found_in(text):
            for literal, own in by.items():
                at = text.find(literal)
                while at >= 0:
                    yield at + len(literal) - 1, (len(literal), *own)
                    at = text.find(literal, at + 1) if own[1] else -1
    else:
        automaton = ahocorasick.Automaton()
        for literal, own in by.items():
            automaton.add_word(literal, (len(literal), *own))
        automaton.make_automaton()
        found_in = lambda text: automaton.iter(text) if by else ()

    def find(text: str) -> dict[int, bool]:
        plain = text.isascii()
        low = text.lower() if plain else text.translate(_ALIKE).lower()
        plain = plain or not any(chr(c) in text for c in _ALIKE)
        met = dict.fromkeys(always, False)
        for end, (size, own, whole) in found_in(low):
            for i in own:
                met.setdefault(i, False)
            if whole:
                beside = (low[end - size] if end >= size else " ") + (low[end + 1] if end + 1 < len(low) else " ")
                if beside[0] in _IN_WORD or beside[1] in _IN_WORD:
                    if plain:
                        continue
                sure = plain and beside.isascii()
                for i in whole:
                    met[i] = met.get(i, False) or sure
        return met

    return find


def finder(keys: list[frozenset[str] | None]) -> Callable[[str], list[int]]:
    """A function from a text to the places of all keys of which it holds a literal, in order; None is held by every text."""
    find = _placed(keys, [None] * len(keys))
    return lambda text: sorted(find(text))


def candidates(packs: dict[str, Pack], policy_set: Column, text: Column) -> Column:
    """The rules of a row's pack that its text may match, in the pack's order; sure: its pattern is known to match."""
    rules, keys, words = [], {}, {}
    first = {}
    for p in packs.values():
        first[p.name] = len(rules)
        rules += [dict(rule=r.id, action=r.action, confidence=r.score, validator=r.validator, pattern=compile_pattern(r.pattern), gate=r.context and compile_pattern(r.context)) for r in p.rules]
        words[p.name] = [m and m[1] for m in (_WORD.fullmatch(r.pattern) for r in p.rules)]
        keys[p.name] = [frozenset() if w else literals(parse(r.pattern)) for r, w in zip(p.rules, words[p.name])]
    table = json.dumps(rules)
    if len(table) > MOST_RULE_BYTES:
        raise ValueError(f"rules of {len(table)} bytes are over {MOST_RULE_BYTES}")
    ready: dict[str, Callable] = {}  # of a worker

    def run(sets: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for name, t in zip(sets.to_pylist(), texts.to_pylist()):
            if t is None or name not in keys:
                out.append(None)
                continue
            if name not in ready:
                ready[name] = _placed(keys[name], words[name])
            met, begin = ready[name](t), first[name]
            out.append([2 * (begin + i) + met[i] for i in sorted(met)])  # a rule's number, and whether it is sure
        return pa.array(out, pa.list_(pa.int32()))

    known = F.from_json(F.lit(table), _RULES)  # a constant

    def rule(x: Column) -> Column:
        r = F.get(known, F.shiftright(x, 1))
        return F.struct(*(r[n].alias(n) for n in ("rule", "action")), r["confidence"].cast("float").alias("confidence"), *(r[n].alias(n) for n in ("validator", "pattern", "gate")), (x % 2 == 1).alias("sure"))

    return F.transform(F.arrow_udf(run, "array<int>")(policy_set, text), rule)


def fires(rule: Column, context: Column, text: Column) -> Column:
    """Whether a candidate fires: gate, pattern, and the validator on the first match, as operators.decide.rule_fires has it."""
    first = F.array(F.call_function("regexp_extract", text, rule["pattern"], F.lit(0)))
    checked = F.lit(None).cast("boolean")
    for name, check in VALIDATORS.items():
        checked = F.when(rule["validator"] == name, F.exists(first, check)).otherwise(checked)
    hit = F.when(rule["validator"].isNull(), F.when(rule["sure"], True).otherwise(F.rlike(text, rule["pattern"]))).otherwise(checked)
    return F.coalesce((rule["gate"].isNull() | F.rlike(context, rule["gate"])) & hit, F.lit(False))


def evaluate_many(df: DataFrame, packs: dict[str, Pack], default: str = "finance-v1", normal: bool = False) -> DataFrame:
    """The same columns and rows as operators.decide.evaluate, whose cost is rules times texts; here it follows the literals found.

    No shuffle and no rule table: rules are part of the task's code, of MOST_RULE_BYTES at most. Use it from a few dozen rules on.
    """
    out = df.withColumn("policy_set", F.coalesce(F.col("policy_set"), F.lit(default)))
    out = out.withColumn("original", original_text(F.col("context"), F.col("prompt"), F.col("response")))
    out = out.withColumn("shadow", shadow(F.col("original"), normal))
    out = out.withColumn("input_hash", sha256_hex(F.col("original"))).withColumn("shadow_hash", sha256_hex(F.col("shadow")))
    out = out.withColumn("policy_hash", by_pack(packs, F.col("policy_set"), lambda p: F.lit(p.pack_hash)))
    out = out.withColumn("tried", candidates(packs, F.col("policy_set"), F.col("shadow")))
    hits = F.filter("tried", lambda r: fires(r, F.col("context"), F.col("shadow")))
    plain = F.transform(hits, lambda r: F.struct(*(r[f.name].alias(f.name) for f in VIOLATION)))
    known = F.col("policy_set").isin(*packs) if packs else F.lit(False)
    # without a text there is no violation, as none of the rules fires
    out = out.withColumn("violations", F.when(known, F.coalesce(plain, F.array().cast(f"array<{VIOLATION.simpleString()}>"))))
    return out.withColumn("decision", F.when(F.col("violations").isNotNull(), decision(F.col("violations")))).drop("tried")
