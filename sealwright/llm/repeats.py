"""Removal of byte strings that another document holds already, by suffix sorting.

Every byte covered by a string of `width` bytes that also starts in a document of smaller id goes.
Sorting all suffixes of a corpus would move it many times over, so only places that may repeat are
sorted. An anchor is the seed (a string of SEED bytes) of smallest hash in some string of width
bytes: equal strings have equal anchors, and a string lies within its anchor's context, the
width - SEED bytes before and width bytes from the anchor on. Seeds' hashes only choose what is sorted: the contexts of
seeds that several documents hold are suffix-sorted, first inside each piece of the input, then, for strings that no
smaller id of the piece holds, seed by seed over all pieces. Common prefixes of at least width bytes, which compare
bytes, show which strings stand in a smaller id; nothing is removed for equal hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm.blobs import active, by_part, grouped, is_prime, pack, table_of, unpack
from sealwright.llm.hot import HOT_DOCS, hot_hashes
from sealwright.llm.scratch import kept
from sealwright.llm.sizing import parts_for
from sealwright.llm.suffixes import common_prefixes, suffix_array
from sealwright.llm.textbuf import BYTE_CODE, U64, buffers, gather_ranges, mix, pieces, powers, window_minima

SEED = 24
_STRIP = 1 << 18
PIECE = 6 << 20  # bytes of text searched at once
_ANCHORS, _INTERVALS, _REQUESTS, _STRINGS = 0, 1, 2, 3
_FINE = 4


def anchors(data: np.ndarray, off: np.ndarray, width: int):
    """(text index, position in text, context begin and end in text, seed hash) of all anchors, in text order.

    A context holds just the strings whose smallest seed this is; of equal hashes all are anchors.
    """
    out = [[], [], [], [], []]
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + _STRIP, side="right")) - 1)
        x, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        m = len(x)
        if m >= width:
            pw, inv = powers(m + 1)
            total = np.zeros(m + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[x] * pw[:m], out=total[1:])
            h = mix((total[SEED:] - total[:-SEED]) * inv[: m - SEED + 1])
            np.maximum(h, U64(1), out=h)
            usable = np.repeat(o[1:], np.diff(o)) - np.arange(m) >= width
            sel = window_minima(h, width - SEED + 1, usable)
            doc = np.searchsorted(o, sel, side="right") - 1
            v, reach = h[sel], width - SEED
            # an anchor's strings begin where the smaller one before it has left, and end before a smaller one comes
            low, high = np.maximum(sel - reach, o[doc]), np.minimum(sel + width, o[doc + 1])
            near = np.flatnonzero(doc[1:] == doc[:-1])
            after = near + 1
            x = after[v[near] < v[after]]
            low[x] = np.maximum(low[x], sel[x - 1] + 1)
            x = near[v[after] < v[near]]
            high[x] = np.minimum(high[x], sel[x + 1] - reach - 1 + width)
            for store, v in zip(out, (doc + a, sel - o[doc], low - o[doc], high - o[doc], h[sel])):
                store.append(v)
        a = b
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
    return [np.concatenate(v) if v else np.zeros(0, k) for v, k in zip(out, kinds)]


def in_smaller(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, width: int):
    """(segment, position in it) of every string of `width` bytes of the segments that a segment of smaller owner holds too.

    The segments data[begin[i] : begin[i] + size[i]] are suffix-sorted together; strings are equal where
    neighbours in that order have width bytes in common. Of segments that are equal byte by byte, the one
    of smallest owner is sorted; all strings of the others are in it.
    """
    whole = np.flatnonzero(size >= width)
    if len(whole) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    copies = _copies(data, begin[whole], size[whole], owner[whole])
    sort, follows = whole[~copies], whole[copies]
    count = size[follows] - width + 1
    of, p = _sorted_hits(data, begin[sort], size[sort], owner[sort], width)
    return np.concatenate([sort[of], np.repeat(follows, count)]), np.concatenate([p, gather_ranges(np.zeros(len(count), np.int64), count)])


def _copies(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which segments equal, byte by byte, one of smaller owner. Hashes only choose with which one a segment is compared."""
    raw = data[gather_ranges(begin, size)]
    end = np.cumsum(size)
    at = end - size
    pw, inv = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[raw] * pw[: len(raw)], out=total[1:])
    code = mix((total[end] - total[at]) * inv[at] + size.astype(np.uint64))
    order = np.lexsort((owner, code))
    new = np.ones(len(order), dtype=bool)
    new[1:] = code[order][1:] != code[order][:-1]
    rep = np.empty(len(order), dtype=np.int64)
    rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = (owner > owner[rep]) & (size == size[rep])
    x = np.flatnonzero(out)
    if len(x):
        same = raw[gather_ranges(at[x], size[x])] == raw[gather_ranges(at[rep[x]], size[x])]
        upto = np.cumsum(size[x])
        out[x] = np.add.reduceat(same, upto - size[x], dtype=np.int64) == size[x]
    return out


def _sorted_hits(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, width: int):
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(begin) < 2:
        return none
    upto = np.cumsum(size + 1)
    at = upto - size - 1
    flat = np.zeros(int(upto[-1]), dtype=np.uint8)
    flat[gather_ranges(at, size)] = np.minimum(data[gather_ranges(begin, size)], 254) + 1
    order = suffix_array(flat, width)
    ends = np.repeat(upto - 1, size + 1)
    order = order[ends[order] - order >= width]
    lcp = common_prefixes(flat, order, width)
    new = lcp < width
    one = new.copy()
    one[:-1] &= new[1:]
    order, new = order[~one], new[~one]  # strings that stand alone need no owner
    if not len(order):
        return none
    of = np.searchsorted(upto, order, side="right")
    least = np.minimum.reduceat(owner[of], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.flatnonzero(owner[of] > least)
    return of[hit], order[hit] - at[of[hit]]


def _shared(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have a hash that entries of another id have too."""
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
    d = ids[order]
    out = np.zeros(len(h), dtype=bool)
    if len(h):
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        out[order] = np.repeat(several, np.diff(np.append(start, len(h))))
    return out


_SPAN_KINDS = [np.int64, np.int32, np.int32]
_ANCHOR_KINDS = [np.int64, np.int32, np.uint8, np.uint8, np.uint32]  # document, position, context before and after it, hash


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Joins intervals of a document that overlap or touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    shift = np.cumsum(first) * (int(end.max()) + 1)  # so that the running maximum never crosses documents
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - shift[last]


def _spans(doc, start, end, parts):
    doc, start, end = _merge(doc, start, end)
    return by_part(doc, parts, _INTERVALS, doc.astype(np.int64), start.astype(np.int32), end.astype(np.int32))


def cut_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, part_bytes: int = 8 << 20, hash_bits: int = 32, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Removes each byte of a text (as UTF-8) that a string of `width` bytes covers which also starts in a document of smaller id.

    Strings never cross documents and are judged on the input. Rows: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 (of the remaining bytes). with_text: the columns
    of docs, the text cut (characters of which only some bytes are left go too), and then these columns.

    A null text is empty (and stays null in with_text). Rows of null id stay whole and cover
    nothing. Equal rows cover each other's successors alike. Of rows that share an id but not the text,
    that of smallest text takes part, the others stay whole. An empty table gives no rows.
    part_bytes: input bytes of a group of documents that one task holds. hash_bits: bits of a seed's hash, beside those
    that name its bucket, by which seeds meet; fewer bits only mean more sorting. hot_docs: see hot_hashes; the
    strings of hot seeds meet one by one, in groups of pieces first, so that no task gathers a hot seed.
    """
    parts = max(parts_for(docs, part_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while not is_prime(parts):  # so that ids of regular steps spread
        parts += 1
    buckets, salts = parts, math.isqrt(parts) + 1
    mask = U64((1 << hash_bits) - 1)
    want = [c for c in docs.columns if c not in (id_col, text_col)] if with_text else []
    base = docs.select(F.col(id_col).cast("long").alias("id__"), F.col(text_col).cast("string").alias("text__"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(want)))
    repeated = base.where("id__ IS NOT NULL").groupBy("id__").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    takes_part = F.col("id__").isNotNull()
    if repeated:
        base = base.withColumn("rank__", F.dense_rank().over(Window.partitionBy("id__").orderBy(F.coalesce("text__", F.lit("")))))
        takes_part = takes_part & (F.col("rank__") == 1)
    base = base.withColumn("active__", takes_part).withColumn("part__", F.pmod(F.coalesce("id__", F.lit(0)), F.lit(parts)).cast("int"))
    texts = base.where("active__").select("id__", "text__")

    def seeds(data, off):
        doc, _, _, _, h = anchors(data, off, width)
        return doc, h

    hot = hot_hashes(texts, seeds, hot_docs)

    def find(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            batch = batch.take(pa.compute.array_sort_indices(batch.column(0)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(1))
            for a, b in pieces(off, PIECE):
                yield from search_piece(ids[a:b], data[off[a] : off[b]], off[a : b + 1] - off[a], turn % salts)
                turn += 1

    def search_piece(ids, data, off, salt):
        doc, pos, low, high, h = anchors(data, off, width)
        x = np.flatnonzero(_shared(h, ids[doc]))
        d, s, e = _merge(doc[x], low[x], high[x])
        of, start = in_smaller(data, off[d] + s, e - s, ids[d], width)
        start = start + s[of]
        rows = [(_INTERVALS, p, b) for _, p, b in _spans(ids[d[of]], start, start + width, parts)]
        # contexts with a string that no smaller id of the piece holds go on
        gone = np.zeros(len(data) + 1, dtype=np.int64)
        gone[off[d[of]] + start + 1] = 1
        np.cumsum(gone, out=gone)
        begin, stop = off[doc] + low, off[doc] + high - width + 1
        left = gone[stop] - gone[begin] < stop - begin
        hot_one = np.isin(h, hot) & left
        if hot_one.any():
            at = np.unique(gather_ranges(begin[hot_one], (stop - begin)[hot_one]))
            at = at[gone[at + 1] == gone[at]]
            code = mix((BYTE_CODE[data[at[:, None] + np.arange(width)]] * powers(width)[0][:width]).sum(axis=1, dtype=np.uint64))
            key = (code % U64(buckets * _FINE)).astype(np.int64)
            own = np.searchsorted(off, at, side="right") - 1
            for k, y in grouped(key):
                rows.append((_STRINGS, k * salts + salt, _ctx(data, ids[own[y]], at[y] - off[own[y]], at[y], np.full(len(y), width))))
        left = np.flatnonzero(left & ~hot_one)
        for k, y in grouped(((h[left] >> U64(40)) % U64(buckets)).astype(np.int64)):
            x = left[y]
            rows.append((_ANCHORS, k, pack(ids[doc[x]].astype(np.int64), pos[x].astype(np.int32), (pos[x] - low[x]).astype(np.uint8), (high[x] - pos[x]).astype(np.uint8), (h[x] & mask).astype(np.uint32))))
        return table_of(rows, ["kind", "key", "blob"], [pa.int32(), pa.int64(), pa.binary()]).to_batches()

    def meet(key, t):
        """Anchors of a bucket: those whose seed another document has too, by their document's part. Spans: joined. Strings: sorted."""
        names, kinds = ["kind", "part__", "bucket", "blob"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        kind, blobs = t.column("kind")[0].as_py(), t.column("blob").to_pylist()
        if kind == _INTERVALS:
            return table_of([(k, p, 0, b) for k, p, b in _spans(*_gather_spans(blobs), parts)], names, kinds)
        if kind == _STRINGS:
            bucket = key[1].as_py() // salts
            doc, start, at, size, data = _read_all(blobs)
            of, _ = in_smaller(data, at, size, doc, width)
            first = np.ones(len(doc), dtype=bool)
            first[of] = False
            y = np.flatnonzero(first)
            rows = [(k, p, 0, b) for k, p, b in _spans(doc[of], start[of], start[of] + width, parts)]
            return table_of([*rows, (_STRINGS, 0, bucket, _ctx(data, doc[y], start[y], at[y], size[y]))], names, kinds)
        doc, pos, before, after, h = (np.concatenate(v) for v in zip(*(unpack(b, _ANCHOR_KINDS) for b in blobs)))
        ask = np.flatnonzero(_shared(h, doc))
        rows = []
        fine = h[ask] % np.uint32(_FINE)
        for sub in range(_FINE):
            x = ask[fine == sub]
            rows += [(k, p, key[1].as_py() * _FINE + sub, b) for k, p, b in by_part(doc[x], parts, _REQUESTS, doc[x], pos[x], before[x], after[x])]
        return table_of(rows, names, kinds)

    search = texts.mapInArrow(find, "kind int, key long, blob binary").repartition(parts, "kind", "key")
    met = kept(search.groupBy("kind", "key").applyInArrow(meet, "kind int, part__ int, bucket long, blob binary"), "repeats")

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes around asked anchors, by bucket: ids, where they begin in their text, lengths, bytes. Contexts that overlap are one."""
        rows = []
        if left.num_rows and right.num_rows:
            ids, data, off = active(left)
            bucket = right.column("bucket").to_numpy()
            blobs = right.column("blob").to_pylist()
            for k, y in grouped(bucket):
                doc, pos, before, after = (np.concatenate(v) for v in zip(*(unpack(blobs[i], _ANCHOR_KINDS[:4]) for i in y.tolist())))
                row, low, high = _merge(np.searchsorted(ids, doc), pos - before, pos + after)
                rows.append((_STRINGS, k, _ctx(data, ids[row], low, off[row] + low, high - low)))
        return table_of(rows, ["kind", "bucket", "blob"], [pa.int32(), pa.int64(), pa.binary()])

    def sort_bucket(t: pa.Table) -> pa.Table:
        doc, start, at, size, data = _read_all(t.column("blob").to_pylist())
        of, p = in_smaller(data, at, size, doc, width)
        p = start[of] + p
        return table_of([(k, p, b) for k, p, b in _spans(doc[of], p, p + width, parts)], ["kind", "part__", "blob"], [pa.int32(), pa.int32(), pa.binary()])

    dealt = base.repartition(parts, "part__").groupBy("part__")
    asked = met.where(F.col("kind") == _REQUESTS).repartition(parts, "part__").groupBy("part__")
    ctx = dealt.cogroup(asked).applyInArrow(contexts, "kind int, bucket long, blob binary")
    ctx = ctx.union(met.where(F.col("kind") == _STRINGS).select("kind", "bucket", "blob"))
    sorted_ = ctx.repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort_bucket, "kind int, part__ int, blob binary")
    spans = met.where(F.col("kind") == _INTERVALS).select("kind", "part__", "blob").union(sorted_).repartition(parts, "part__")

    digest = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        own_types = {f.name: f.dataType for f in base.schema.fields}
        order_ = [(c, "id__" if c == id_col else "text__" if c == text_col else f"own_{want.index(c)}") for c in docs.columns]
        fields = [T.StructField(f"c{i}", own_types[src]) for i, (_, src) in enumerate(order_)]
    else:
        order_, fields = [(id_col, "id__")], [T.StructField("c0", T.LongType())]
    schema = T.StructType([*fields, *digest])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id__").to_pylist()
        live = left.column("active__").to_pylist()
        doc, start, end = _merge(*_gather_spans(right.column("blob").to_pylist())) if right.num_rows else [np.zeros(0, np.int64)] * 3
        n_bytes, removed, count, sha, text = [], [], [], [], []
        for i, on, t in zip(ids, live, left.column("text__").to_pylist()):
            raw = (t or "").encode()
            lo, hi = np.searchsorted(doc, [i, i + 1]) if on else (0, 0)
            left_ = raw
            if hi > lo:
                at, pieces = 0, []
                for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist()):
                    pieces.append(raw[at:a])
                    at = b
                left_ = b"".join([*pieces, raw[at:]])
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(left_))
            count.append(int(hi - lo))
            sha.append(hashlib.sha256(left_).hexdigest())
            text.append(t if left_ is raw else left_.decode("utf-8", "ignore"))
        columns = [pa.array(text, pa.string()) if src == "text__" else left.column(src) for _, src in order_]
        return pa.Table.from_arrays([*columns, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=[f.name for f in schema])

    out = dealt.cogroup(spans.groupBy("part__")).applyInArrow(finish, schema)
    if with_text:
        return out.select(*(F.col(f"c{i}").alias(c) for i, (c, _) in enumerate(order_)), *(f.name for f in digest))
    return out.withColumnRenamed("c0", "doc_id")


def _gather_spans(blobs):
    found = [unpack(b, _SPAN_KINDS) for b in blobs]
    return [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def _ctx(data, doc, start, at, size) -> bytes:
    return pack(doc.astype(np.int64), start.astype(np.int64), size.astype(np.int64)) + data[gather_ranges(at, size)].tobytes()


def _read_all(blobs: list[bytes]):
    """(document, where it begins there, where in the bytes, length) of all segments of _ctx blobs, and their bytes."""
    doc, start, size = (np.concatenate(v) for v in zip(*(unpack(b, [np.int64] * 3) for b in blobs)))
    data = np.concatenate([np.frombuffer(b, np.uint8, offset=8 + 24 * int(np.frombuffer(b, np.int64, 1)[0])) for b in blobs])
    return doc, start, np.cumsum(size) - size, size, data
