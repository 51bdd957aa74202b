"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent between 0 (all alike) and 1
(in proportion), normalised. The exponent is found by bisection: the largest that reaches a target
entropy, or the largest that keeps within a repetition limit for a token budget. Weights are
realised as passes over the source's blocks, each pass in an order of its own, until the
source's part of the budget is used; the last pass ends within a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealwright.llm.scratch import kept

_BIN = 65536.0
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """exponent, normaliser (sum of shares to the exponent), budget in tokens, all tokens."""

    exponent: float
    normaliser: float
    budget: float
    tokens: float


def _bisect(ok: Callable[[float], bool]) -> float:
    """The exponent nearest 1 that is ok, for a condition that holds from some exponent down to 0; 0 where none is."""
    if ok(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def solve(bins: list[tuple[float, int]], tokens: float, budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = None) -> Mix:
    """bins: (share of one source, number of such sources), shares above 0.

    target_entropy (nats): the largest exponent whose weights have at least this entropy; 0 if
    even equal weights have less. max_repeats: the smallest exponent at which no source is seen
    more often than this; 1 if none complies. Both: the repetition limit, as the entropy then has
    to give way. budget None: the least budget that sees every source whole at least once.
    """
    total = sum(s * n for s, n in bins) or 1.0
    bins = [(s / total, n) for s, n in bins]

    def z(a: float) -> float:
        return sum(n * s**a for s, n in bins)

    def entropy(a: float) -> float:
        return math.log(z(a)) - sum(n * s**a * a * math.log(s) for s, n in bins) / z(a)

    def budget_at(a: float) -> float:
        return budget if budget is not None else tokens * max((s ** (1 - a) for s, _ in bins), default=1.0) * z(a)

    def repeats(a: float) -> float:
        return budget_at(a) / max(tokens, 1) * max((s ** (a - 1) for s, _ in bins), default=1.0) / z(a)

    exponent = 1.0
    if bins and target_entropy is not None:
        exponent = _bisect(lambda a: entropy(a) >= target_entropy - 1e-12)
    if bins and max_repeats is not None and repeats(exponent if target_entropy is not None else 0.0) > max_repeats * (1 + 1e-12):
        exponent = 1.0 - _bisect(lambda u: repeats(1.0 - u) <= max_repeats * (1 + 1e-12))
    elif bins and max_repeats is not None and target_entropy is None:
        exponent = 0.0
    return Mix(exponent, z(exponent) if bins else 1.0, budget_at(exponent) if bins else 0.0, tokens)


def _source_key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))


def _order_hash(pass_col: Column, seed: int, *cols: Column) -> Column:
    return F.xxhash64(*cols, pass_col, F.lit(seed))


def plan_mix(docs: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = 256, seed: int = 17):
    """(Mix, picks): picks has source_key, block, pass, position, upto.

    A pick takes one block of a source in one pass: whole where upto is null, else its rows whose
    order in this pass (the hash of id and pass) is at most upto. position (0 to 1) tells when in
    the mixture it is due: in order of position every prefix of the mixture holds about the
    target weights. Only (source, block) sums and a histogram of shares leave the rows' tasks.
    """
    key = _source_key(source_col).alias("source_key")
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("tokens")
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(blocks)).cast("int").alias("block")
    rows = kept(docs.select(F.col(id_col).alias("id"), key, tokens, block), "mix-rows")
    sums = kept(rows.groupBy("source_key", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = sums.groupBy("source_key").agg(F.sum("tokens").alias("source_tokens"))
    total = float(sources.agg(F.sum("source_tokens")).first()[0] or 0)
    share = F.col("source_tokens") / F.lit(max(total, 1.0))
    binned = sources.where("source_tokens > 0").groupBy(F.round(F.log(share) * _BIN).alias("b")).agg(F.avg(share).alias("share"), F.count("*").alias("n"))
    mix = solve([(r["share"], r["n"]) for r in binned.orderBy("b").collect()], total, budget, target_entropy, max_repeats)
    weight = F.when(F.col("source_tokens") > 0, F.pow(share, F.lit(mix.exponent)) / F.lit(mix.normaliser)).otherwise(0.0)
    ratio = F.when(F.col("source_tokens") > 0, weight * F.lit(mix.budget) / F.col("source_tokens")).otherwise(1.0)
    repeats = F.round(ratio, 9)
    if budget is None:  # shares are known to a bin's width only; no source may fall under one pass for that
        repeats = F.greatest(repeats, F.lit(1.0))
    quotas = sources.withColumn("repeats", repeats).withColumn("passes", F.ceil("repeats").cast("int"))
    by_pass = sums.join(quotas, "source_key").withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.col("passes"), F.lit(1)) - 1)))
    order = Window.partitionBy("source_key", "pass").orderBy(_order_hash(F.col("pass"), seed, F.col("source_key"), F.col("block")), "block")
    placed = by_pass.withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    left = F.greatest((F.col("repeats") - F.col("pass")) * F.col("source_tokens") - F.col("before"), F.lit(0.0))
    full = (F.col("repeats") >= F.col("pass") + 1) | (left >= F.col("tokens"))
    placed = placed.withColumn("left", left).withColumn("full", full).where("full OR left > 0")
    position = F.when(F.col("source_tokens") > 0, (F.col("pass") + F.col("before") / F.col("source_tokens")) / F.col("repeats")).otherwise(0.0)
    placed = kept(placed.select("source_key", "block", "pass", position.alias("position"), "full", "left"), "mix-placed")
    cut = placed.where("NOT full")
    mine = rows.join(cut, ["source_key", "block"]).withColumn("order_", _order_hash(F.col("pass"), seed, F.col("id")))
    running = Window.partitionBy("source_key", "block", "pass").orderBy("order_")
    inside = mine.withColumn("upto_tokens", F.sum("tokens").over(running)).where(F.col("upto_tokens") <= F.col("left"))
    limits = inside.groupBy("source_key", "block", "pass").agg(F.max("order_").alias("upto"))
    picks = placed.join(limits, ["source_key", "block", "pass"], "left").where("full OR upto IS NOT NULL")
    return mix, rows, picks.select("source_key", "block", "pass", "position", F.when(~F.col("full"), F.col("upto")).alias("upto"))


def _taken(rows: DataFrame, picks: DataFrame, id_col: str, seed: int) -> DataFrame:
    joined = rows.join(picks, ["source_key", "block"])
    return joined.where(F.col("upto").isNull() | (_order_hash(F.col("pass"), seed, F.col(id_col)) <= F.col("upto")))


def mix_rows(docs: DataFrame, budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = 256, seed: int = 17) -> DataFrame:
    """What the mixture takes, without texts: doc_id, source_key, pass, block, position, tokens. One row per copy taken.

    Tokens are words. A null source is a source of its own (`null`; others are written `=name`);
    sources without tokens are taken once. Rows of equal id share a block and are taken together.
    Null texts have no tokens. An empty table gives no rows.
    """
    _, rows, picks = plan_mix(docs, budget, target_entropy, max_repeats, id_col, text_col, source_col, blocks, seed)
    return _taken(rows, picks, "id", seed).select(F.col("id").alias("doc_id"), "source_key", F.col("pass").cast("int").alias("pass"), "block", "position", "tokens")


def mix(docs: DataFrame, budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = 256, seed: int = 17) -> DataFrame:
    """The mixture itself: rows of docs with their own columns, each as often as it is taken. Edge cases as in mix_rows."""
    _, _, picks = plan_mix(docs, budget, target_entropy, max_repeats, id_col, text_col, source_col, blocks, seed)
    picks = picks.select(*(F.col(c).alias(f"{c}__mix") for c in picks.columns))
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(blocks)).cast("int")
    joined = docs.join(picks, (_source_key(source_col) == F.col("source_key__mix")) & (block == F.col("block__mix")))
    joined = joined.where(F.col("upto__mix").isNull() | (_order_hash(F.col("pass__mix"), seed, F.col(id_col)) <= F.col("upto__mix")))
    return joined.select(*docs.columns)
