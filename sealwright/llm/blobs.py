"""Many small rows as a few binary ones: arrays of a group laid end to end, dealt by their document's part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sealwright.llm.textbuf import buffers


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length end to end, after that length."""
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    """The arrays of pack, of the given kinds."""
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(blob[at : at + size], k))
        at += size
    return out


def by_part(doc, parts, kind, *arrays):
    """Rows (kind, part, blob) of arrays dealt by their document's part."""
    part = doc % parts
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    return [(kind, int(part[a]), pack(*(x[order[a:b]] for x in arrays))) for a, b in zip(cuts, [*cuts[1:], len(part)])]


def grouped(key: np.ndarray):
    """(value, positions) of each value of key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
    return [(int(k[a]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(k)])]


def table_of(rows, names, kinds):
    """An Arrow table of rows given as tuples."""
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def is_prime(n: int) -> bool:
    """Whether n is a prime number."""
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def active(t: pa.Table):
    """Ids in ascending order, and the bytes and offsets of the texts that take part, one for each id."""
    t = t.select(["id__", "text__", "active__"]).filter(t.column("active__")).sort_by("id__")
    ids = t.column("id__").to_numpy()
    data, off = buffers(t.column("text__"))
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if len(first) < len(ids):  # equal rows
        t = t.take(pa.array(first))
        ids = ids[first]
        data, off = buffers(t.column("text__"))
    return ids, data, off
