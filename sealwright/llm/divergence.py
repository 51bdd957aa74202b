"""How far the sources of a language differ in their words: a tournament of all pairs of sources.

Each language's common terms are dealt into buckets, and each source (a group) gets a vector of smoothed
shares for every bucket. Groups sit in a few seats and stay in the partitions of (language, bucket, seat); in
every round of a round-robin tournament each seat meets another one: only the travelling seats' compressed
vectors move. A meeting serves both directions. Sums of a meeting are partial, one for each bucket.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealwright.llm.scratch import kept, shared_path
from sealwright.llm.terms import LETTERS, pieces_of_terms, texts_of

SCALE = 1_000_000_000
MIN_DOCS, TOP = 10, 10
_FLUSH = 400_000  # distinct (group, term) that a task counts before it hands them on
_BUCKET_TERMS, _BUCKET_ENTRIES, _MIN_BUCKETS = 1 << 14, 1 << 20, 32
_SEAT_GROUPS, _MOST_SEATS = 8, 16
_KEYS = ["lang", "bucket", "seat"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, docs, n) summed over what a task has read so far; a row without term tells that the group occurs."""
    occurs: dict[tuple, Counter] = {}
    within: dict[tuple, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in occurs.items():
            d = within[lang, source]
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1), pa.string()),
                    pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([*terms, None], pa.binary()).cast(pa.string()),
                    pa.array([*(d[t] for t in terms), 0], pa.int64()),
                    pa.array([*n.values(), 0], pa.int64()),
                ],
                ["lang", "source", "term", "docs", "n"],
            )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
            key = (lang, source)
            n, d, seen = occurs.setdefault(key, Counter()), within.setdefault(key, Counter()), set()
            held -= len(n)
            for words in pieces_of_terms(text, LETTERS):
                n.update(words)
                seen.update(words)
            d.update(seen)
            held += len(n)
            if held > _FLUSH:
                yield from flush()
                occurs, within, held = {}, {}, 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): in how many documents of a group a term stands, and how often. Null lang, source and text are empty; a null term marks each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, "lang string, source string, term string, docs long, n long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division to the base 1000: exact up to 9e15 occurrences."""
    whole = total + 2 * terms
    if whole >= 9 * 10**15:
        raise OverflowError(f"{whole} occurrences are beyond exact 64-bit shares")
    rest = count.astype(np.int64) + 2
    out = rest // whole * SCALE  # only where one term is all there is
    rest %= whole
    for step in (1_000_000, 1_000, 1):
        rest *= 1000
        out += rest // whole * step
        rest %= whole
    return out + 1


def _shares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses each segment's ids (differences) and shares; absent terms have the share `p0`."""
    for batch in batches:
        *_, found, total, terms, size = (batch.column(i) for i in range(batch.num_columns))
        data, low = [], []
        for pairs, n, v in zip(found.to_pylist(), total.to_pylist(), terms.to_pylist()):
            ids = np.array([x["id"] for x in pairs or []], np.int32)
            p = shares(np.array([x["n"] for x in pairs or []], np.int64), n, v) if len(ids) else np.zeros(0, np.int64)
            data.append(zstandard.compress(np.diff(ids, prepend=np.int32(0)).astype(np.int32).tobytes() + p.astype(np.int32).tobytes(), 3))
            low.append(int(shares(np.zeros(1, np.int64), n, v)[0]) if v else 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), size, pa.array(low, pa.int64()), pa.array(data, pa.binary())], ["lang", "bucket", "seat", "seats", "source", "size", "p0", "data"])


class Segment:
    """One group's shares in one bucket: ids that occur, their shares, the share of all others."""

    def __init__(self, source: str, size: int, p0: int, data: bytes):
        self.source, self.size, self.p0 = source, size, p0
        both = np.frombuffer(zstandard.decompress(data), np.int32)
        self.ids, self.p = np.cumsum(both[: len(both) // 2], dtype=np.int64), both[len(both) // 2 :].astype(np.int64)

    def at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the given ids, and which of them occur."""
        i = np.searchsorted(self.ids, ids)
        inside = i < len(self.ids)
        inside[inside] = self.ids[i[inside]] == ids[inside]
        p = np.full(len(ids), self.p0, np.int64)
        p[inside] = self.p[i[inside]]
        return p, inside


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); the same in both directions."""
    return (p - q) ** 2 // (p + q)


def meet(a: Segment, b: Segment) -> int:
    """Sum of gaps over all terms of a bucket; terms that neither has count by their number."""
    if not a.size:
        return 0
    q, _ = b.at(a.ids)
    p, shared = a.at(b.ids)
    rest = a.size - len(a.ids) - len(b.ids) + int(shared.sum())
    both = int(gap(a.p, q).sum()) + int(gap(p[~shared], b.p[~shared]).sum())
    return both + rest * int(gap(np.int64(a.p0), np.int64(b.p0)))


_MET = "lang string, source string, item string, bucket int, id int, value long"  # item of a pair, bucket and id of a term


def _segments(t: pa.Table) -> list[Segment]:
    return [Segment(*r) for r in zip(*(t.column(c).to_pylist() for c in ("source", "size", "p0", "data")))]


def _rows(home: pa.Table, pairs: list[tuple[Segment, Segment]], best: list[tuple[str, int, int]]) -> pa.Table:
    """Both directions of each meeting, and (source, id, value) of terms."""
    met = [(x.source, y.source, None, v) for a, b in pairs for v in (meet(a, b),) for x, y in ((a, b), (b, a))] + [(source, None, i, v) for source, i, v in best]
    lang, bucket = (home.column(c)[0].as_py() if met else None for c in ("lang", "bucket"))
    columns = [[lang] * len(met), [r[0] for r in met], [r[1] for r in met], [bucket] * len(met), [r[2] for r in met], [r[3] for r in met]]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "bucket", "id", "value"])


def _visit(home: pa.Table, away: pa.Table) -> pa.Table:
    """Every resident of a seat with every traveller that has come to it."""
    here, there = _segments(home), _segments(away)
    return _rows(home, [(a, b) for a in here for b in there], [])


def _at_home(home: pa.Table, whole: pa.Table) -> pa.Table:
    """The residents of a seat among themselves, and each one's heap of the terms that it has more of than its language: (value, smaller id) first."""
    here, best = _segments(home), []
    for lang_vector in _segments(whole):
        for a in here:
            q, _ = lang_vector.at(a.ids)
            more = a.p > q
            value, ids = gap(a.p[more], q[more]), a.ids[more]
            best += [(a.source, -i, v) for v, i in heapq.nlargest(TOP, zip(value.tolist(), (-ids).tolist()))]
    return _rows(home, [(a, b) for i, a in enumerate(here) for b in here[i + 1 :]], best)


def partner(seat: Column, seats: Column, round_no: int) -> Column:
    """Whom a seat meets in a round of the circle method: the last seat stays, the others rotate by one a round."""
    ring = seats - 1
    other = F.pmod(F.lit(round_no) - seat, ring)
    fixed = F.pmod(F.lit(round_no) * F.floor((ring + 1) / 2).cast("int"), ring)  # the one that meets itself meets the last
    return F.when(seat == ring, fixed).when(other == seat, ring).otherwise(other).cast("int")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """How each source of a language differs from the others, and by which terms.

    Terms are runs of letters, A-Z lower-cased; a language keeps those that stand in at least
    min_docs of its documents. A group is an occurring (lang, source); its share of a term is
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), the gap of two shares floor((p - q)^2 / (p + q)), all in
    integers. Rows: lang, source, part, item, value, rank. Part `pair`: each other source of the
    language with the sum of gaps over all kept terms. Part `term`: the ten terms with the largest gaps among
    those that the source has more of than its language. Ranks go by value, then item.

    Null lang, source and text are empty strings; groups without terms take part; repeated rows count
    repeatedly; an empty table gives no rows; other columns are ignored. A source that is alone in its
    language has no pairs.

    Documents are read once and leave their tasks as summed counts. Nothing is held whole: a task has one bucket
    of one or two seats. Buckets follow vocabulary and counts, so their size does not grow with the corpus.
    """
    spark = docs.sparkSession
    counts = kept(term_counts(docs), "term-counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    words = counts.where("term IS NOT NULL")
    vocabulary = kept(words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("entries")).where(F.col("docs") >= min_docs).drop("docs"), "vocabulary")

    seats = F.least(F.lit(_MOST_SEATS), (2 * F.ceil(F.col("groups") / (2 * _SEAT_GROUPS))).cast("int"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("entries").alias("entries"), F.sum("total").alias("total")), "lang", "left")
    sizes = sizes.na.fill(0).select("lang", "terms", "total", seats.alias("seats"), F.greatest(F.lit(_MIN_BUCKETS), F.ceil(F.col("terms") / _BUCKET_TERMS), F.ceil(F.col("entries") / (seats * _BUCKET_ENTRIES))).cast("int").alias("buckets"))
    sizes = kept(sizes, "languages")
    dealt = vocabulary.join(sizes.select("lang", "buckets"), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    terms = kept(dealt.select("lang", "bucket", "term", "total", (F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1).alias("id")), "terms")
    entries = kept(words.join(terms, ["lang", "term"]).select("lang", "bucket", "source", "id", "n"), "entries")

    pairs = F.array_sort(F.collect_list(F.struct("id", "n"))).alias("found")
    bucket_sizes = terms.groupBy("lang", "bucket").agg(F.count("*").cast("int").alias("size"))
    seated = groups.join(sizes, "lang").withColumn("seat", F.pmod(F.row_number().over(Window.partitionBy("lang").orderBy("source")), F.col("seats")).cast("int"))
    seated = seated.drop("total").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
    all_segments = seated.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    all_segments = all_segments.join(entries.groupBy("lang", "bucket", "source").agg(pairs), ["lang", "bucket", "source"], "left").join(bucket_sizes, ["lang", "bucket"], "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    kind = "lang string, bucket int, seat int, seats int, source string, size int, p0 long, data binary"
    vectors = all_segments.select("lang", "bucket", "seat", "seats", "source", "found", zero("own", "long"), "terms", zero("size", "int")).mapInArrow(_shares_of, kind)
    whole = terms.groupBy("lang", "bucket").agg(F.array_sort(F.collect_list(F.struct("id", F.col("total").alias("n")))).alias("found"), F.count("*").cast("int").alias("size"))
    whole = whole.join(sizes, "lang").withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    whole = whole.select("lang", "bucket", "seat", "seats", F.lit("").alias("source"), "found", "total", "terms", "size").mapInArrow(_shares_of, kind)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = kept(vectors, "vectors").repartition(parts, *_KEYS).persist()
    by_seat = resident.groupBy(*_KEYS)
    path = shared_path(spark, "meetings")
    by_seat.cogroup(whole.repartition(parts, *_KEYS).groupBy(*_KEYS)).applyInArrow(_at_home, _MET).write.parquet(f"{path}/round=-1")
    most = sizes.agg(F.max("seats")).first()[0] or 0
    for r in range(most - 1):
        host = partner(F.col("seat"), F.col("seats"), r)
        away = resident.where((F.lit(r) < F.col("seats") - 1) & (host < F.col("seat"))).withColumn("seat", host)
        by_seat.cogroup(away.repartition(parts, *_KEYS).groupBy(*_KEYS)).applyInArrow(_visit, _MET).write.parquet(f"{path}/round={r}")
    resident.unpersist()

    rows = spark.read.schema(_MET).parquet(*(f"{path}/round={r}" for r in range(-1, most - 1)))
    met = rows.where("id IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = rows.where("id IS NOT NULL").select("lang", "source", "bucket", "id", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = best.join(terms.select("lang", "bucket", "id", "term"), ["lang", "bucket", "id"]).select("lang", "source", F.col("term").alias("item"), "value")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(met, "pair").unionByName(ranked(named, "term").where(F.col("rank") <= TOP))
