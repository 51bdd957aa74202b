"""SimHash fingerprints, and permuted block tables that find those within a Hamming radius.

Terms are a text's pairs of neighbouring words (ASCII letters lower-cased), or its one word; each
occurrence of a term votes with the term's weight for or against every bit of the fingerprint, by
the bits of the term's hash. A term's weight is the logarithm of its bytes: long words are rarer. Weights
are whole numbers, so sums are exact and a tied vote is always against the bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.llm.sizing import parts_for
from sealwright.llm.textbuf import U64, buffers, mix, words

BITS = 128
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)  # byte -> 8 votes
_CHUNK = 512


def _terms(data: np.ndarray, off: np.ndarray):
    """Hash, weight and text of each term."""
    starts, ends, w, first = words(data, off)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    paired = np.flatnonzero(doc[1:] == doc[:-1])
    alone = first[:-1][count == 1]
    h = np.concatenate([mix((w[paired] * U64(0xC2B2AE3D27D4EB4F)) ^ w[paired + 1]), w[alone]])
    size = np.concatenate([ends[paired + 1] - starts[paired], (ends - starts)[alone]])
    return h, np.rint(np.log2(1.0 + size) * 1024), np.concatenate([doc[paired], doc[alone]])


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of BITS / 8 bytes for each text laid end to end; a text without words has zeros."""
    n = len(off) - 1
    out = np.zeros((n, BITS // 8), dtype=np.uint8)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        h, weight, doc = _terms(data[off[a] : off[b]], off[a : b + 1] - off[a])
        base, has = doc * 256, np.bincount(doc, minlength=b - a) > 0
        for half in range(BITS // 64):
            for i in range(8):
                byte = ((h >> U64(8 * i)) & U64(255)).astype(np.int64)
                votes = np.bincount(base + byte, weights=weight, minlength=(b - a) * 256).reshape(-1, 256) @ _SIGNS
                out[a:b, half * 8 + i] = np.packbits((votes > 0) & has[:, None], axis=1)[:, 0]
            h = mix(h * U64(0x9E3779B97F4A7C15) + U64(half + 1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of differing bits, row by row."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(rows: np.ndarray) -> list[str]:
    flat, step = rows.tobytes().hex(), rows.shape[1] * 2
    return [flat[i : i + step] for i in range(0, len(flat), step)]


COARSE = 1000  # ranges of keys that the driver takes quantiles for; each is cut evenly into more


def with_following(docs: DataFrame, parts: int, key: str = "doc_id") -> DataFrame:
    """Deals rows in ranges of key, sorted, each range followed by the next range's first row.

    Adds columns key_, part_ and halo_ (1: a copy that only shows what follows; 0: the row itself).
    After the last range comes the first row of all. Each row crosses the network once. The driver sees at most COARSE
    quantiles, and the smallest key of each range: 16 bytes for part_bytes of input.
    """
    keyed = docs.withColumn("key_", F.coalesce(F.col(key), F.lit(-(1 << 63))))
    n = min(parts, COARSE)
    probs = [i / n for i in range(1, n)]
    bounds = sorted({int(x) for x in keyed.approxQuantile("key_", probs, 0.1 / n)}) if probs else []
    ends = keyed.agg(F.min("key_"), F.max("key_")).first()
    edges = np.array([ends[0] or 0, *bounds, ends[1] or 0], dtype=np.float64)
    fine = -(-parts // n)

    def part_of(s: pd.Series) -> np.ndarray:
        k = s.to_numpy(np.int64)
        at = np.searchsorted(np.array(bounds, dtype=np.int64), k, side="right")
        within = (k.astype(np.float64) - edges[at]) / np.maximum(edges[at + 1] - edges[at], 1.0) * fine
        return at * fine + np.clip(within, 0, fine - 1).astype(np.int64)

    part_udf = F.pandas_udf(lambda s: pd.Series(part_of(s)), "int")
    firsts = keyed.select("key_", part_udf("key_").alias("p")).groupBy("p").agg(F.min("key_").alias("low")).toArrow().sort_by("p")
    low, own = firsts.column("low").to_numpy(), firsts.column("p").to_numpy()
    before = np.roll(own, 1)  # the range before each one's smallest key

    @F.pandas_udf("array<int>")
    def parts_of(s: pd.Series) -> pd.Series:
        k = s.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(low, k), len(low) - 1)
        return pd.Series([[p, q] if first else [p] for p, q, first in zip(part_of(s).tolist(), before[at].tolist(), (low[at] == k).tolist())])

    dealt = keyed.select("*", F.posexplode(parts_of("key_")).alias("halo_", "part_"))
    return dealt.repartition(parts, "part_").sortWithinPartitions("part_", "halo_", "key_")


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of whole texts and of edited texts, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document in ascending id (after the last: the first). One row per document: doc_id,
    n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (hex), near_edited
    and near_next (share of equal bits).

    A null text is empty; texts without words have the fingerprint of zeros. Null ids sort
    first. Rows of equal id follow each other by their text. Equal texts have equal
    fingerprints. An empty table gives no rows. Other columns are ignored. part_bytes: input bytes a task
    sorts.
    """
    parts = max(parts_for(docs, part_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = with_following(rows, parts).sortWithinPartitions("part_", "halo_", "key_", "text").select("doc_id", "text", "halo_")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            own = fingerprints(*buffers(batch.column(1)))
            ids, texts, halo = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if carry is not None:
                ids, texts, halo, own = [carry[0], *ids], [carry[1], *texts], [carry[2], *halo], np.vstack([carry[3], own])
            carry = (ids[-1], texts[-1], halo[-1], own[-1:])
            at = [i for i in range(len(ids) - 1) if not halo[i]]
            if not at:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
            fp = fingerprints(*buffers(pa.array(edited, pa.large_string())))
            mine, following = own[at], own[np.array(at) + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in at], pa.int64()),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(_hex(mine)),
                    pa.array(_hex(fp)),
                    pa.array(likeness(mine, fp)),
                    pa.array(likeness(mine, following)),
                ],
                names,
            )

    return dealt.mapInArrow(run, schema)


def _block(fp: Column, i: int, blocks: int) -> Column:
    digits = BITS // 4
    a, b = digits * i // blocks, digits * (i + 1) // blocks
    return F.substring(fp, a + 1, b - a)


def within_radius(fps: DataFrame, radius: int = 3, id_col: str = "doc_id", fp_col: str = "fingerprint") -> DataFrame:
    """All pairs of different fingerprints at most `radius` bits apart: fp_a < fp_b, distance.

    The fingerprint is cut into radius + 1 blocks, so a pair within the radius agrees on a
    block: each block has a table keyed by it, and only rows that share a block meet. Equal
    fingerprints are one class, whose members the input itself lists, so copies are not
    expanded into pairs. Null fingerprints take no part. An empty table gives no rows.
    """
    blocks = radius + 1
    distinct = fps.select(F.col(fp_col).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    tables = distinct.select("fp", F.posexplode(F.array(*[_block(F.col("fp"), i, blocks) for i in range(blocks)])).alias("block_no", "block"))
    other = tables.withColumnRenamed("fp", "fp_b")
    pairs = tables.withColumnRenamed("fp", "fp_a").join(other, ["block_no", "block"]).where("fp_a < fp_b")
    words_ = [(i * 16 + 1) for i in range(BITS // 64)]
    # 64-bit parts by two 32-bit halves: conv() is unsigned, bit_count() wants a long
    parts = [F.bit_count(F.conv(F.substring("fp_a", p, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("fp_b", p, 8), 16, 10).cast("long"))) for q in words_ for p in (q, q + 8)]
    distance = sum(parts[1:], parts[0])
    return pairs.select("fp_a", "fp_b", distance.cast("int").alias("distance")).where(F.col("distance") <= radius).distinct()
