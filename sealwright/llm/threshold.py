"""Ranked search by Fagin's threshold algorithm, in shards of documents.

Every shard holds lists of (document, impact) for each term, the highest impact first, and a forward index. A query's lists
are read in turns; a document that shows up is scored at once by the forward index. Once the sum of the impacts
reached in the lists is strictly below the k-th best score, no unseen document can be among the best k.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealwright.llm.scratch import kept
from sealwright.llm.terms import LETTERS_DIGITS, pieces_of_terms, texts_of

TOP = 10
_BLOCK_ITEMS, _BLOCK_BYTES = 1024, 4 << 20  # of the queries that are answered at once
_SHARD_ENTRIES = 1 << 21  # (document, term) that a task indexes at once
_FIRST_DEPTH = 64
_NULL_LAST = np.iinfo(np.int64).max


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts in a document, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:  # ties with the k-th stay in
        few = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Shard:
    """Impact-sorted lists and the forward index of some documents."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.ids, self.offsets, self.terms, self.impact = ids, offsets, terms, impact
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        # impacts are under 2^20, so one number orders by term, then by falling impact
        order = np.argsort((terms.astype(np.int64) << 20) + ((1 << 20) - 1 - impact), kind="stable")
        self.docs, self.sorted_impact = doc[order].astype(np.int32), impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.weight = np.zeros(vocabulary, np.int64)  # of the query at hand
        self.seen = np.zeros(len(ids), dtype=bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from the forward index."""
        n = self.offsets[docs + 1] - self.offsets[docs]
        ends = np.cumsum(n)
        at = np.repeat(self.offsets[docs] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        parts = np.concatenate([[0], np.cumsum(self.weight[self.terms[at]] * self.impact[at])])
        return parts[ends] - parts[ends - n]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) among this shard's documents and `best`, those of earlier shards.

        A turn reads some entries of every list, more from turn to turn: that is sorted access with a coarser end.
        """
        self.weight[terms] = weights
        low, high = self.starts[terms], self.starts[terms + 1]
        depth, step, looked = 0, _FIRST_DEPTH, []
        while True:
            a, b = np.minimum(low + depth, high), np.minimum(low + depth + step, high)
            if not (b > a).any():
                break
            came = np.concatenate([self.docs[x:y] for x, y in zip(a.tolist(), b.tolist())])
            came = np.unique(came[~self.seen[came]])
            self.seen[came] = True
            looked.append(came)
            score = self.scores(came)
            took = score > 0
            scores, ids = np.concatenate([best[0], score[took]]), np.concatenate([best[1], self.ids[came[took]]])
            keep = best_of(scores, ids, k)
            best = scores[keep], ids[keep]
            depth, step = depth + step, step * 2
            left = b < high  # an unread document has at most the impact last read, and none of a list read to its end
            reached = int((weights[left] * self.sorted_impact[b[left] - 1]).sum())
            if len(keep) == k and reached < best[0][-1]:
                break
        for docs in looked:
            self.seen[docs] = False
        self.weight[terms] = 0
        return best


def _forward(vocabulary: dict[bytes, int]):
    """Each document with terms: (id, n, ids of query terms, their counts)."""
    known = vocabulary.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                n, count = 0, Counter()
                for words in pieces_of_terms(text, LETTERS_DIGITS):
                    n += len(words)
                    count.update(words)
                if n:
                    own = sorted((vocabulary[t], count[t]) for t in count.keys() & known)
                    rows.append((doc, n, [x[0] for x in own], [x[1] for x in own]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc", "n", "terms", "tf"])

    return run


def _searcher(sent, docs_total: int, terms_total: int, k: int):
    """Shard by shard of a partition, every query; the best of a task go on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries)

        def search(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids = t.column("doc").fill_null(_NULL_LAST).to_numpy().astype(np.int64)
            n, terms, tf = (t.column(c).combine_chunks() for c in ("n", "terms", "tf"))
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            m = 25 + 75 * n.to_numpy(zero_copy_only=False).astype(np.int64) * docs_total // terms_total
            found = tf.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            shard = Shard(ids, np.concatenate([[0], np.cumsum(lengths)]), terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), impacts(found, np.repeat(m, lengths)), len(weight))
            for i, (own, times) in enumerate(queries):
                best[i] = shard.search(own, weight[own] * times, k, best[i])

        held, entries = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                entries += len(part.column(part.schema.get_field_index("terms")).flatten())
                if entries >= _SHARD_ENTRIES:
                    search(held)
                    held, entries = [], 0
        if held:
            search(held)
        rows = [(i, d, s) for i, (scores, ids) in enumerate(best) for s, d in zip(scores.tolist(), ids.tolist())]
        columns = [[r[0] for r in rows], [None if r[1] == _NULL_LAST else r[1] for r in rows], [r[2] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    return run


def _answer(docs: DataFrame, items: list[tuple], kind: str, k: int) -> DataFrame:
    """The best documents of one block of items (id, text)."""
    spark = docs.sparkSession
    counts = [Counter(w for p in pieces_of_terms((text or "").encode(), LETTERS_DIGITS) for w in p) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    index = kept(docs.mapInArrow(_forward(vocabulary), "doc long, n long, terms array<int>, tf array<long>"), "forward-index")
    docs_total, terms_total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * docs_total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    queries = []
    for c in counts:
        own = np.array(sorted(vocabulary[t] for t in c), np.int64)
        times = {vocabulary[t]: n for t, n in c.items()}
        queries.append((own, np.array([times[i] for i in own.tolist()], np.int64)))
    sent = spark.sparkContext.broadcast((queries, weight))
    found = index.mapInArrow(_searcher(sent, docs_total, max(1, terms_total), k), "query int, doc_id long, score long")
    order = lambda *keys: F.row_number().over(Window.partitionBy("query", *keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    first = found.withColumn("group", F.spark_partition_id() % 64).withColumn("rank", order("group")).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", order()).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"query int, item_id {kind}")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = _BLOCK_ITEMS, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """The k best documents for every item: item_id, rank, doc_id, score.

    Terms are runs of letters and digits of whole texts, A-Z lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))), its impact in a document floor(10^9 tf / (1000 tf + 8 m)) with
    m = 25 + floor(75 n N / L); scores sum weight times impact over the item's terms, repeats included. Only scores above 0
    count; equal ones go by ascending doc_id.

    Each row of documents is a document of its own; null ids come last among equal scores; null and empty texts have no terms and
    aren't counted. Repeated equal rows of items are one item; items without terms, and those that no document fits, have no
    rows, as have empty tables. Other columns are ignored.

    Items are answered in blocks of about block_items and block_bytes, which bounds what is broadcast. For each block the texts
    are read once into a forward index of the block's terms; shards of it are indexed and searched inside the
    tasks, whose k best meet in groups first.
    """
    kind = dict(items.dtypes)["item_id"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    asked = kept(items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct(), "items")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in asked.where(block == b).collect()]
        if rows:
            got = _answer(texts, rows, kind, k)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
