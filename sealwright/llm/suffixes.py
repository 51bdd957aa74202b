"""Two-stage suffix sorting of a byte text, and its adjacent common prefixes.

Stage one sorts only the suffixes smaller than their successors. Stage two scans the buckets of
equal first bytes in ascending order and induces the others: the suffix before each one met goes
to the front of its bucket, in the order met. A text is made of segments that end in a 0 byte;
suffixes are compared up to the end of their segment, equal ones stand in any order.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors: by the first differing byte to the right."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    up = np.zeros(n, dtype=np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    known = np.flatnonzero(up)  # runs of equal bytes take the sign at their end
    at = np.searchsorted(known, np.arange(n))
    has = at < len(known)
    out[has] = up[known[at[has]]] > 0
    return out


def _words_at(text: np.ndarray, room: int) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; what follows a 0 byte, a segment's end, is 0. `room` zeros stand after the end."""
    n = len(text)
    out = np.zeros(n + room + 8, dtype=np.uint64)
    out[:n] = text
    for k in (1, 2, 4):
        ended = (out & np.uint64(0xFF)) == 0
        after = np.zeros_like(out)
        after[:-k] = out[k:]
        after[ended] = 0
        out = (out << np.uint64(8 * k)) | after
    return out


def _direct_sort(words: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """Sorts suffixes by their bytes up to their segment's end, or to about `longest` bytes."""
    order = np.argsort(words[at])
    at = at[order]
    group = np.zeros(len(at), dtype=np.int64)  # rank of the prefix seen so far
    live = np.arange(len(at))  # positions of at whose prefix isn't unique and hasn't ended
    key = words[at]
    k = 0
    while len(live):
        new = np.ones(len(live), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (group[live[1:]] != group[live[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(live)))
        group[live] = np.repeat(live[start], size)
        live = live[np.repeat(size > 1, size) & ((key & np.uint64(0xFF)) != 0)]
        k += 1
        if 8 * k > longest:
            break
        own, g = at[live], group[live]
        key = words[own + 8 * k]
        by_key = np.argsort(key)
        rank = np.empty(len(key), dtype=np.int64)
        ordered = key[by_key]
        rank[by_key] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if len(key) else []
        order = np.argsort((g << 32) | rank)
        at[live], key = own[order], key[order]
    return at


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in ascending order, without those that begin with the segments' 0 byte.

    text: uint8 bytes 1 to 255, segments each ended by 0. longest: the longest segment, or how many bytes
    decide: suffixes that agree in so many may stand in any order.
    """
    n = len(text)
    small = smaller_than_next(text)
    small[text == 0] = False
    first = _direct_sort(_words_at(text, longest + 8), np.flatnonzero(small), longest)
    counts = np.bincount(text, minlength=256)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(n, dtype=np.int64)
    small_counts = np.bincount(text[first], minlength=256) if len(first) else np.zeros(256, np.int64)
    at = np.cumsum(small_counts)
    for c in range(1, 256):  # sorted ones stand at the end of their bucket
        if small_counts[c]:
            out[begin[c + 1] - small_counts[c] : begin[c + 1]] = first[at[c] - small_counts[c] : at[c]]
    out[begin[0] : begin[1]] = np.flatnonzero(text == 0)
    front = begin[:-1].copy()  # where the next induced suffix of each bucket goes

    def induce(met: np.ndarray) -> None:
        prev = met[met > 0] - 1
        prev = prev[~small[prev] & (text[prev] != 0)]
        if not len(prev):
            return
        c = text[prev]
        order = np.argsort(c, kind="stable")
        sizes = np.bincount(c, minlength=256)
        target = np.repeat(front - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(prev))
        out[target] = prev[order]
        front[:] += sizes

    induce(out[begin[0] : begin[1]])
    for c in range(1, 256):
        done = begin[c]
        while done < front[c]:  # induced ones of this bucket may induce more of it
            upto = front[c]
            induce(out[done:upto])
            done = upto
        if small_counts[c]:
            induce(out[begin[c + 1] - small_counts[c] : begin[c + 1]])
    return out[begin[1] :]


def common_prefixes(text: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, within segments; the first has 0. Counted to about `longest`."""
    out = np.zeros(len(order), dtype=np.int64)
    if len(order) < 2:
        return out
    words = _words_at(text, longest + 8)
    live, depth = np.arange(1, len(order)), 0
    while len(live) and depth < longest:
        x, y = words[order[live - 1] + depth], words[order[live] + depth]
        differ = x ^ y
        on = (differ == 0) & ((x & np.uint64(0xFF)) != 0)
        out[live[on]] += 8
        x, differ, ended = x[~on], differ[~on], live[~on]
        # bytes before the first that differs; of equal words, before the segment's end
        same = (differ.byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        whole = np.flatnonzero(differ == 0)
        same[whole] = np.count_nonzero(x[whole].view(np.uint8).reshape(-1, 8), axis=1)
        out[ended] += same
        live = live[on]
        depth += 8
    return out
