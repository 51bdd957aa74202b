"""Near-duplicate documents by SetSketch registers over word shingles.

Each register keeps floor(1 - log_base(h)) of the smallest of exponentially distributed hashes
h of the set's elements: exponentially spaced, truncated minima. Registers of a union are the
larger ones, and registers of similar sets are often equal. Bands of registers give candidate clusters;
inside them pairs are estimated from all registers by maximum likelihood of the Jaccard
similarity, and those that might reach the threshold are confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwright.llm.components import components
from sealwright.llm.hot import hot_keys, join_hot
from sealwright.llm.scratch import kept
from sealwright.llm.textbuf import U64, buffers, pieces, shingles, words

BASE, RATE, LIMIT = 1.02, 20.0, 4095
REGISTERS, ROWS = 200, 4
BLOCK = 4096  # classes of a band that meet in one task
PIECE = 1 << 20  # bytes of text whose sets a task makes at once
_STRIP = 1 << 16
_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and where each text's begin."""
    _, _, w, first = words(data, off)
    h, at = shingles(w, first, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    starts = at[:-1][at[:-1] < len(h)]
    new[starts] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return h[new], upto[at]


def _sets_of(batches, k: int):
    """Slices of batches (id, text, ...) of about PIECE bytes of text, one row at least, with their shingle_sets: what a task
    holds beside a batch doesn't grow with it."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        for a, b in pieces(off, PIECE):
            yield batch.slice(a, b - a), *shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)


def sketch(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (uint16) of the sets h[at[i]:at[i+1]]; an empty set has zeros."""
    n = len(at) - 1
    low = np.full((n, REGISTERS), 0xFFFFFFFF, dtype=np.uint32)
    x = (h >> U64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + _STRIP, side="right")) - 1)
        own = x[at[a] : at[b]]
        full = np.flatnonzero(at[a + 1 : b + 1] > at[a:b])
        if len(full):
            starts = at[a:b][full] - at[a]
            for i in range(REGISTERS):
                low[a + full, i] = np.minimum.reduceat(own * _MUL[i] + _ADD[i], starts)
        a = b
    least = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
    out = np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, LIMIT).astype(np.uint16)
    out[at[1:] == at[:-1]] = 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.concatenate([np.arange(0.02, 0.5, 0.04), np.arange(0.5, 1.0, 0.01), [0.9999]])


def estimate(a: np.ndarray, na: int | np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard similarity of one set (registers a, size na), or of each row of a, with the rows of b (sizes nb).

    How many registers are larger, smaller and equal is multinomial, with chances that follow from
    the sizes and the similarity.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u) * 0.9999)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-9))
    return j[np.arange(len(b)), np.argmax(fit, axis=1)]


def slack(threshold: float) -> float:
    """Five standard errors of an estimate near the threshold."""
    return 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Members:
    """Documents of one group, with registers and full sets."""

    def __init__(self, t: pa.Table):
        self.ids = t.column("doc_id").to_pylist()
        self.sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
        self.n = np.array([len(s) for s in self.sets])
        self.registers = np.stack([np.frombuffer(x, np.uint16) for x in t.column("registers").to_pylist()]) if self.ids else np.zeros((0, REGISTERS), np.uint16)

    def near(self, other: _Members, i: int, among: np.ndarray, percent: int) -> list[int]:
        """Which of `among` (positions here) are linked to document i of other."""
        n = other.n[i]
        among = among[100 * np.minimum(self.n[among], n) >= percent * np.maximum(self.n[among], n)]
        if not len(among):
            return []
        guess = estimate(other.registers[i], n, self.registers[among], self.n[among])
        among = among[guess >= percent / 100 - slack(percent / 100)]
        return [k for k in among.tolist() if _linked(other.sets[i], self.sets[k], percent)]


def _join_rest(m: _Members, component: np.ndarray, rest: np.ndarray, block: np.ndarray, pair: tuple[int, int], band: int, percent: int) -> list[tuple[int, int]]:
    """Links of a band's classes that join components, from the classes `rest` to any others.

    A pair is looked at in the first band it shares only, and only between the two blocks of this task. Likelier pairs are
    confirmed first, and none whose classes are joined already.
    """
    label, found, n = component.copy(), [], len(m.ids)
    bands = m.registers.reshape(n, -1, ROWS)
    asking = np.flatnonzero(rest)
    step = max(1, (1 << 16) // n)
    for a in range(0, len(asking), step):
        i, k = np.repeat(asking[a : a + step], n), np.tile(np.arange(n), len(asking[a : a + step]))
        ok = (label[i] != label[k]) & (block[k] == np.where(block[i] == pair[0], pair[1], pair[0])) & (~rest[k] | (i < k))
        ok &= 100 * np.minimum(m.n[i], m.n[k]) >= percent * np.maximum(m.n[i], m.n[k])
        i, k = i[ok], k[ok]
        for x in range(band):  # a pair that shares an earlier band is looked at there
            apart = (bands[i, x] != bands[k, x]).any(axis=1)
            i, k = i[apart], k[apart]
        if not len(i):
            continue
        guess = estimate(m.registers[i], m.n[i], m.registers[k], m.n[k])
        order = np.argsort(-guess, kind="stable")
        for x in order[guess[order] >= percent / 100 - slack(percent / 100)].tolist():
            p, q = int(i[x]), int(k[x])
            if label[p] != label[q] and _linked(m.sets[p], m.sets[q], percent):
                found.append((m.ids[p], m.ids[q]))
                label[label == label[q]] = label[p]
    return found


def _band_keys(registers: str = "registers"):
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(F.col(registers).substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i))


def _resolve(m: _Members, percent: int) -> list[tuple[int, int]]:
    """(smallest id of its component, id) of each document of a group that is linked to another: each document in turn
    meets those not reached yet, newly reached ones first."""
    left = np.arange(len(m.ids))
    found, todo, own = [], [], []
    while len(left) or todo:
        if not todo:
            found.append(own)
            todo, left = [int(left[0])], left[1:]
            own = [m.ids[todo[0]]]
        i = todo.pop()
        if len(left):
            hit = m.near(m, i, left, percent)
            own += [m.ids[k] for k in hit]
            todo += hit
            left = left[~np.isin(left, hit)]
    return [(min(c), x) for c in [*found, own] if len(c) > 1 for x in c]


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text", chunk: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A document's set holds its distinct k-word shingles (words: runs without ASCII white space,
    A-Z lower-cased; fewer than k words: the whole sequence; no words: empty, linked with nothing).
    Documents are linked where 100 * common >= percent * union. component_id is the smallest
    doc_id reachable over links; kept tells whether it is the row's own.

    Equal sets are one class from the start. Candidate clusters are the components of sharing a
    band of ROWS registers; two sets of similarity 0.75 miss each other in all bands with chance
    6e-9. A cluster of more than `chunk` classes is dealt into chunks that all hold the cluster's
    most central class. Classes that don't come to be joined with it then meet, band by band, the classes of other
    components that share the band.
    So no pair of the cluster that could join two components goes unseen. A band of more than BLOCK classes of other components is met block by block.

    A null text is empty. Null ids have a null component_id and are kept. Rows of equal id are
    one document. An empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches):
        for batch, h, at in _sets_of(batches, k):
            reg = sketch(h, at)
            size = np.diff(at)
            sums = np.zeros((len(size), 2), dtype=np.uint64)
            full = size > 0
            if full.any():
                mixed = h * U64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> U64(29)
                starts = at[:-1][full]
                sums[full, 0], sums[full, 1] = np.add.reduceat(mixed, starts), np.bitwise_xor.reduceat(mixed * U64(0xC2B2AE3D27D4EB4F), starts)
            flat = reg.tobytes()
            step = REGISTERS * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), pa.array([flat[i * step : (i + 1) * step] for i in range(len(size))], pa.binary())],
                ["doc_id", "n", "set_a", "set_b", "registers"],
            )

    all_ = kept(plain.mapInArrow(describe, "doc_id long, n long, set_a long, set_b long, registers binary"), "sketches")
    full = all_.where("n > 0 AND doc_id IS NOT NULL")
    classes = kept(full.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    alone = full.join(classes.select(F.col("rep").alias("doc_id"), "n", "set_a", "set_b"), ["doc_id", "n", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id"])
    alone = kept(alone.select("doc_id", "registers"), "class-sketches")

    # candidate clusters
    bands = alone.select("doc_id", F.explode(_band_keys()).alias("key"))
    shared = kept(bands.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1"), "bands")
    edges = kept(join_hot(bands, shared, "key", "doc_id", hot_keys(shared, "key")).select("doc_id", "center", "n"), "band-edges")
    clusters = components(edges.select(F.col("doc_id").alias("a"), F.col("center").alias("b")).where("a <> b"))
    weight = edges.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("weight"))
    nodes = kept(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(weight, "doc_id"), "cluster-nodes")
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("n"), F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("pivot"))
    sizes = kept(sizes.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "cluster-sizes")
    dealt = join_hot(nodes.select("doc_id", "cluster"), sizes, "cluster", "doc_id", hot_keys(sizes, "cluster"))
    dealt = dealt.select("doc_id", "cluster", "chunks", "pivot", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"))

    def gather(batches):
        for batch, h, at in _sets_of(batches, k):
            reg, raw = sketch(h, at).tobytes(), h.tobytes()
            step = REGISTERS * 2
            sets = [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            regs = [reg[i * step : (i + 1) * step] for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", *batch.schema.names[2:], "registers", "members"])

    with_text = plain.join(dealt, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "cluster", "chunks", "pivot", "chunk")
    cand = kept(with_text.mapInArrow(gather, "doc_id long, cluster long, chunks int, pivot long, chunk int, registers binary, members binary"), "cluster-sets")

    # links inside each chunk, with the cluster's pivot in every chunk
    columns = ["doc_id", "cluster", "chunk", "registers", "members"]
    split = cand.where("chunks > 1")
    pivots = split.where("doc_id = pivot").withColumn("chunk", F.explode(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("chunk"))))
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def table_of(links):
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))], schema=link_schema)

    resolve = lambda t: table_of(_resolve(_Members(t), percent))
    final = kept(cand.where("chunks = 1").select(columns).groupBy("cluster", "chunk").applyInArrow(resolve, "a long, b long"), "links").select(F.col("b").alias("rep"), F.col("a").alias("component"))

    # classes of a divided cluster that aren't joined with its pivot meet the other chunks
    if sizes.where("chunks > 1").limit(1).count():

        def around_pivot(t: pa.Table) -> pa.Table:
            cluster, pivot = t.column("cluster")[0].as_py(), t.column("pivot")[0].as_py()
            links = _resolve(_Members(t), percent)
            own = next((a for a, b in links if b == pivot), None)
            rows = [(cluster, a, b, a == own) for a, b in links if b != pivot]
            return pa.Table.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows) if rows else ((),) * 4, around_schema)], schema=around_schema)

        # only the pivot is in several chunks, so what a cluster's chunks join is what joins it
        around_schema = pa.schema([("cluster", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("main", pa.bool_())])
        chunks = split.select(*columns, "pivot").union(pivots.select(*columns, "pivot")).groupBy("cluster", "chunk")
        links = kept(chunks.applyInArrow(around_pivot, "cluster long, a long, b long, main boolean"), "links")
        hot = hot_keys(sizes.where("chunks > 1"), "cluster")
        tops = links.where("main").groupBy("cluster").agg(F.min("a").alias("top"))
        others = join_hot(links, tops, "cluster", "b", hot, "left").select(F.col("b").alias("node"), F.expr("IF(main, top, a)").alias("component"))
        joined = kept(others.union(sizes.join(tops, "cluster").select("pivot", "top")), "joined")
        own = split.select("doc_id", "cluster", "pivot", "registers").join(joined, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id"))
        own = kept(own.select("doc_id", "cluster", "pivot", "registers", "component"), "joined-classes")
        main = own.where("doc_id = pivot").select("cluster", F.col("component").alias("main"))
        marked = join_hot(own.select("doc_id", "cluster", "registers", "component"), main, "cluster", "doc_id", hot)
        met = kept(marked.select("doc_id", "component", (F.col("component") != F.col("main")).alias("rest"), F.posexplode(_band_keys()).alias("band", "key")), "band-classes")
        asked = met.groupBy("key").agg(F.count("*").alias("n"), F.max("rest").alias("any"), F.min("component").alias("low"), F.max("component").alias("high"))
        asked = kept(asked.where("any AND low <> high").select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "asked-bands")
        rows = join_hot(met, asked.select("key", "blocks"), "key", "doc_id", hot_keys(asked, "key"))
        block, other = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.withColumn("block", block).withColumn("other", other)
        rows = kept(rows.select("doc_id", "component", "rest", "band", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "across")

        buckets = -(-rows.count() // BLOCK) + 1  # many small bands are one group of the task

        def across(t: pa.Table) -> pa.Table:
            t = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
            key, i, j, band = (t.column(c).to_numpy() for c in ("key", "i", "j", "band"))
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            found = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                own = t.slice(a, b - a)
                get = lambda name: own.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                found += _join_rest(_Members(own), get("component"), get("rest"), get("block"), (int(i[a]), int(j[a])), int(band[a]), percent)
            return table_of(found)

        with_sets = rows.join(cand.select("doc_id", "registers", "members"), "doc_id")
        bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)).alias("bucket")
        more = kept(with_sets.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(across, "a long, b long").distinct(), "links")
        # over components instead of documents the new links are few
        of = joined.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        of_b = joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        lifted = more.join(of, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
        merged = kept(components(lifted), "merged")
        whole = joined.union(lifted.select(F.col("a").alias("node"), F.col("a").alias("component")).union(lifted.select("b", "b")).distinct().join(joined.select("node"), "node", "left_anti"))
        whole = whole.join(merged.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left")
        final = final.union(whole.select(F.col("node").alias("rep"), F.coalesce("above", "component").alias("component")))

    # every row of docs
    names = ["n", "set_a", "set_b"]
    several = classes.where("copies > 1").select(F.xxhash64(*names).alias("set"), *(F.col(c).alias(f"{c}_") for c in names), "rep", "copies")
    copies = join_hot(full.select("doc_id", *names, F.xxhash64(*names).alias("set")), several.drop("copies"), "set", "doc_id", hot_keys(several, "set", "copies"))
    copies = kept(copies.where("n = n_ AND set_a = set_a_ AND set_b = set_b_ AND doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    reps = copies.select("rep").distinct().join(final, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = copies.groupBy("rep").agg(F.count("*").alias("n"))
    of_copies = join_hot(copies, reps, "rep", "doc_id", hot_keys(counts, "rep")).select("doc_id", "component")
    known = of_copies.union(final.select(F.col("rep").alias("doc_id"), "component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = all_.select("doc_id", F.col("n").alias("n_shingles")).join(known, "doc_id", "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
