"""Whole-batch views of Arrow string columns and vectorised hashes over them.

Every function works on the UTF-8 bytes of many texts laid end to end, so that the
per-byte work is a few numpy passes inside a Spark task. Nothing here knows Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_STRIP = 1 << 18  # positions hashed at once: fits the cache, bounds temporary arrays

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

# The ASCII white space that separates words (space, tab to carriage return).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0], have, step = 1, 1, base
    while have < n:  # powers double: base^(k+have) = base^k * base^have
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(step)
        have, step = have + take, step * step % (1 << 64)
    return out


_pow, _inv = _powers(_BASE, _STRIP + 4096), _powers(_BASE_INV, _STRIP + 4096)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    global _pow, _inv
    if n > len(_pow):
        _pow, _inv = _powers(_BASE, n * 5 // 4), _powers(_BASE_INV, n * 5 // 4)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place): spreads polynomial hashes over all bits."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9FB21C651E98DF25)
    h ^= h >> U64(32)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of all texts, and the first word of each text.

    Words are runs of bytes other than ASCII white space; none crosses a text's end.
    The fourth array has one entry more than there are texts.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    space = IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_or(space[:-1], edge[1:n], out=before[1:])
    starts = np.flatnonzero(before & ~space)
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_or(space[1:], edge[1:n], out=after[:-1])
    ends = np.flatnonzero(after & ~space) + 1
    out = hash_ranges(data, starts, ends, BYTE_CODE[LOWER] if lower else BYTE_CODE)
    return starts, ends, out, np.searchsorted(starts, off)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]], both ascending; equal bytes (of equal codes) have equal hashes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _STRIP, side="right")))
        size = int(ends[j - 1] - at)
        pw, inv = powers(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(codes[data[at : at + size]] * pw[:size], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * inv[s]
        i = j
    return mix(out)


def shingles(w: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and the first of each text (one entry more).

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    count = np.diff(first)
    n_of = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(n_of)])
    out = np.empty(int(start[-1]), dtype=np.uint64)
    if not len(out):
        return out, start
    doc = np.repeat(np.arange(len(count)), n_of)
    at = first[doc] + (np.arange(len(out)) - start[doc])
    short = count[doc] < k
    full = at[~short]
    h = np.zeros(len(full), dtype=np.uint64)
    for i in range(k):
        h = (h + w[full + i]) * U64(0xC2B2AE3D27D4EB4F)
        h ^= h >> U64(31)
    out[~short] = h
    for i in np.flatnonzero(short):  # rare: whole short texts
        x = 0x51ED270B * int(count[doc[i]])
        for y in w[first[doc[i]] : first[doc[i] + 1]].tolist():
            x = ((x + y) * 0xC2B2AE3D27D4EB4F) % (1 << 64)
            x ^= x >> 31
        out[i] = x
    return mix(out), start


def gather_ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0]+1, ... of all ranges, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(begin - (ends - length), length)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values; len(x) - width + 1 results."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def window_minima(h: np.ndarray, width: int, usable: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest h of some usable run of `width` values.

    usable[p] tells whether the run that starts at p counts. Ties are all kept, so equal
    runs always give the same positions.
    """
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = sliding_min(h, width)
    low = np.where(usable[: len(low)], low, U64(0))
    padded = np.zeros(len(h) + width - 1, dtype=np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    high = ~sliding_min(~padded, width)  # the largest minimum of the runs that hold i
    return np.flatnonzero((high == h) & (high > 0))


def pieces(off: np.ndarray, most_bytes: int):
    """Ranges of texts of about most_bytes together, one text at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most_bytes, side="right")) - 1)
        yield a, b
        a = b


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that stand for the values of h, which of them stands for each entry).

    Sorts the upper bits with the position in the lower ones, so a value may get more than one
    standing position where upper bits collide; entries of one position are always equal.
    """
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    ordered = h[order]
    new = np.ones(len(h), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    which = np.empty(len(h), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which
