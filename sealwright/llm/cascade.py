"""URL rules by Bloom filter cascades: exact membership over all keys of a corpus, without a join.

A rule's key is its host and path. Level 1 of a cascade encodes the listed keys; level 2 those keys of the corpus that
level 1 takes for listed though they aren't; level 3 the listed ones that level 2 takes for those, and so on until no
wrong key is left. A key of the corpus is listed if the first level that doesn't hold it has an even number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm.scratch import kept
from sealwright.llm.textbuf import mix

MAX_BYTES, MOST_SHAPES, MOST_LEVELS = 64 << 20, 4096, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level:
    """A Bloom filter: `hashes` bits of every key are set among `bits`."""

    def __init__(self, number: int, keys: int, wrong: float):
        self.number, self.hashes = number, max(1, round(-math.log2(wrong)))
        self.bits = max(64, 64 * math.ceil(max(keys, 1) * self.hashes / math.log(2) / 64))
        self.words = np.zeros(self.bits // 64, np.uint64)

    def positions(self, h: np.ndarray, g: np.ndarray, i: int) -> np.ndarray:
        """The i-th bit of each key; h, g: two hashes of it."""
        salt = np.uint64((self.number * 64 + i) * 0x9E3779B97F4A7C15 % (1 << 64))
        return mix(h + salt * (g | np.uint64(1))) % np.uint64(self.bits)

    def holds(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        found = np.arange(len(h))
        for i in range(self.hashes):  # most keys fall out early
            at = self.positions(h[found], g[found], i)
            found = found[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(h), dtype=bool)
        out[found] = True
        return out


class Cascade:
    """Levels of one list; holds() is exact for its keys and for all keys of the corpus it was built on."""

    def __init__(self):
        self.levels: list[Level] = []

    def holds(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(h), dtype=bool), np.arange(len(h))
        for level in self.levels:
            passed = level.holds(h[left], g[left])
            out[left[~passed]] = level.number % 2 == 0
            left = left[passed]
        out[left] = len(self.levels) % 2 == 1  # what passes all levels was encoded in the last
        return out


def _hash_columns(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g")]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _set_bits(level: Level, hashes: DataFrame) -> None:
    """Fills a level: tasks send the words of 64 bits in which they set some, Spark joins them by `or`."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g = _unsigned(batch.column(0)), _unsigned(batch.column(1))
            at = np.concatenate([level.positions(h, g, i) for i in range(level.hashes)])
            word, mask = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            once, first = np.unique(word[order], return_index=True)
            joined = np.bitwise_or.reduceat(mask[order], first) if len(once) else mask
            yield pa.RecordBatch.from_arrays([pa.array(once.astype(np.int64)), pa.array(joined.view(np.int64))], ["word", "mask"])

    found = hashes.select("h", "g").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    level.words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)


def _passing(spark: SparkSession, level: Level, keys: DataFrame) -> DataFrame:
    """Keys that a level holds."""
    sent = spark.sparkContext.broadcast(level)

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.holds(_unsigned(batch.column(1)), _unsigned(batch.column(2)))))

    return keys.select("key", "h", "g").mapInArrow(holds, "key string, h long, g long")


def build(listed: DataFrame, universe: DataFrame, total: int, max_bytes: int = MAX_BYTES) -> Cascade:
    """A cascade of listed keys (column key) that is exact over the universe's keys (column key; repeats and listed ones may be among them).

    total: about how many keys the universe has; it only sets the size of level 1. No set of keys reaches the driver, only bits: about 1.44 log2(universe / listed) + 5 for a listed key. A list that
    needs more than max_bytes at a level is refused before anything is built; split it by host then.
    """
    spark, out = listed.sparkSession, Cascade()
    inside = kept(listed.select("key").where(F.col("key").isNotNull()).distinct().select("key", *_hash_columns(F.col("key"))), "listed")
    n = inside.count()
    if not n:
        return out
    wrong = min(0.5, max(2.0**-20, n / max(1, total)))  # then level 2 is about as large as level 1
    outside = universe.where(F.col("key").isNotNull()).select("key", *_hash_columns(F.col("key")))
    now, others, count = inside, outside, n
    while count:
        level = Level(len(out.levels) + 1, count, wrong)
        if level.bits > 8 * max_bytes:
            raise ValueError(f"{count} keys take {level.bits // 8} bytes at level {level.number}, over max_bytes={max_bytes}")
        if level.number > MOST_LEVELS:
            raise ValueError(f"{count} keys can't be told apart by their hashes")
        _set_bits(level, now)
        out.levels.append(level)
        held = _passing(spark, level, others)
        if level.number == 1:  # listed keys of the universe aren't wrong ones
            held = held.withColumn("own", F.lit(0)).union(inside.withColumn("own", F.lit(1))).groupBy("key", "h", "g").agg(F.max("own").alias("own")).where("own = 0").drop("own")
        held = kept(held, f"level-{level.number}")
        now, others, count, wrong = held, now, held.count(), 0.5
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host stands between the first :// and the next /, ? or #, with A-Z in lower case; the path goes on to ? or #. Both are empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with key, labels and length of the path; a null or empty host, or a verdict that is neither allow nor block, is an error."""
    d = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    if bad := d.where("coalesce(host, '') = '' OR host LIKE '%/%' OR (path <> '' AND path NOT LIKE '/%') OR coalesce(verdict, '') NOT IN ('allow', 'block')").first():
        raise ValueError(f"not a rule: {bad}")
    return d.select(F.concat("host", "path").alias("key"), "verdict", _labels(F.col("host")).alias("labels"), F.length("path").alias("length"))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys that a rule fitting a URL may have, longest first: for each shape (labels of the host, characters of the path) the host's last labels and the path's first characters."""
    own = _labels(host)
    keys = [F.when((own >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    found = F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")
    host_end = lambda k: F.instr(F.concat(k, F.lit("/")), "/")
    first = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(host_end(b) - host_end(a))
    return F.array_sort(found, first)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rule that fits each URL best, and its verdict: page_id, host, path, rule, verdict.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains where the URL's path starts with
    its own. The longest rule (host and path) wins, among equally long ones that with the longer host. A rule on both lists
    allows. URLs that no rule fits are allowed, as they stand on no list: their rule is null.

    Null URLs and those without :// have an empty host and path, so no rule fits. Rows come back one for one, with repeated rows
    and null ids; an empty table gives none; other columns are ignored. No rules: all is allowed.

    Two cascades are built, of the block and of the allow keys, each exact over every candidate key of the pages. URLs are
    read four times (count, keys of each list, judgement) and never shuffled; of keys, those that pass level 1 are.
    """
    spark = pages.sparkSession
    keys = kept(rule_keys(rules).distinct(), "rules")
    shapes = [tuple(r) for r in keys.select("labels", "length").distinct().orderBy("labels", "length").limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"rules have over {MOST_SHAPES} shapes of host labels and path length")
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    found = parts.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    universe = found.select(F.explode("keys").alias("key"))
    total = found.agg(F.sum(F.size("keys"))).first()[0] or 0 if shapes else 0
    sent = spark.sparkContext.broadcast({v: build(keys.where(F.col("verdict") == v), universe, total, max_bytes) for v in ("allow", "block")})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The verdict and place of the first key of each row that is on a list."""
        for batch in batches:
            *rows, h, g = (batch.column(i) for i in range(batch.num_columns))
            ends = np.cumsum([0, *(h.value_lengths().to_numpy(zero_copy_only=False) if len(h) else [])])
            x, y = _unsigned(h.flatten()), _unsigned(g.flatten())
            lists = {v: c.holds(x, y) for v, c in sent.value.items()}
            hits = np.flatnonzero(lists["allow"] | lists["block"])
            first = np.searchsorted(hits, ends[:-1])
            some = first < len(hits)
            some[some] = hits[first[some]] < ends[1:][some]
            place = np.zeros(len(some), np.int32)
            place[some] = hits[first[some]] - ends[:-1][some] + 1
            allowed = ~some
            allowed[some] = lists["allow"][hits[first[some]]]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(place), pa.array(np.where(allowed, "allow", "block").astype(object), pa.string())], ["page_id", "host", "path", "keys", "place", "verdict"])

    hashed = found.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h"), F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("g"))
    kind = dict(pages.dtypes)[id_col]
    judged = hashed.mapInArrow(judge, f"page_id {kind}, host string, path string, keys array<string>, place int, verdict string")
    return judged.select("page_id", "host", "path", F.get("keys", F.col("place") - 1).alias("rule"), "verdict")
