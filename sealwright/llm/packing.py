"""Cost-balanced packing of token sequences.

A document's cost in a training step is estimated as linear plus quadratic in its length
(the projections, and the attention over its own tokens). Documents go in descending order of
length to the sequence of lowest cost so far that has room; what fits nowhere is cut. Packing
works pool by pool inside each input partition, so it moves no text between machines and holds
one pool at a time; what doesn't fill a sequence is carried to the next pool.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwright.llm.textbuf import buffers, pieces
from sealwright.llm.wordbpe import WordBpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
TEXT_PIECE = 1 << 20  # bytes of text that are encoded at once
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_coders: dict[str, WordBpe] = {}


def piece_cost(length: float, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def place(lengths: list[int], n: int, room: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Fills n sequences of `room` tokens: [(item, start in item, length, sequence)], and [(item, start, length)] left over.

    Items come in descending order of length (ties: as given). Each goes whole to the sequence
    of lowest cost among those with room for it; an item with no such sequence is cut to fill
    the one with the most room, and its rest is tried again.
    """
    placed, left = [], []
    heap = [(0.0, s) for s in range(n)]
    space = [room] * n
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    todo = [(-lengths[i], i, 0) for i in order]
    heapq.heapify(todo)
    open_ = n
    while todo:
        size, item, start = heapq.heappop(todo)
        size = -size
        if not open_:
            left.append((item, start, size))
            continue
        aside, chosen = [], None
        while heap:
            cost, s = heapq.heappop(heap)
            if space[s] >= size:
                chosen = (cost, s)
                break
            if space[s]:
                aside.append((cost, s))
        take = size
        if chosen is None:  # no sequence has room: cut
            chosen = max(aside, key=lambda x: (space[x[1]], -x[0], -x[1]))
            aside.remove(chosen)
            take = space[chosen[1]]
            heapq.heappush(todo, (take - size, item, start + take))
        for x in aside:
            heapq.heappush(heap, x)
        cost, s = chosen
        placed.append((item, start, take, s))
        space[s] -= take
        if space[s]:
            heapq.heappush(heap, (cost + piece_cost(take, linear, quadratic), s))
        else:
            open_ -= 1
    return placed, left


def _powers_of_two(n: int, most: int) -> list[int]:
    out = [most] * (n // most)
    n %= most
    while n:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out


class _Packer:
    """Packs one partition's documents; rows come out as Arrow batches."""

    def __init__(self, room: int, linear: float, quadratic: float, first: int, pool: int):
        self.room, self.linear, self.quadratic, self.next, self.pool = room, linear, quadratic, first, pool
        self.items: list[tuple[int | None, int, int, np.ndarray]] = []  # (doc_id, tokens before, doc_tokens, ids)
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.items.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)

    def _rows(self, filled: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        filled.sort(key=lambda x: (x[3], x[0], x[1]))
        rows, last, offset = [], None, 0
        for item, start, take, s in filled:
            doc_id, before, total, ids = self.items[item]
            offset = 0 if s != last else offset
            own = ids[start : start + take].astype("<u4")
            rows.append((doc_id, before + start, take, zlib.crc32(own.tobytes()), total, s, offset, piece_cost(take, self.linear, self.quadratic)))
            last, offset = s, offset + take
        kinds = [pa.int64()] * 7 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        n = self.held // self.room
        if n:
            cut = []  # a document beyond a sequence's length starts with whole sequences
            for i, (_, _, _, ids) in enumerate(self.items):
                cut += [(i, p, min(self.room, len(ids) - p)) for p in range(0, len(ids), self.room)]
            placed, left = place([x[2] for x in cut], n, self.room, self.linear, self.quadratic)
            yield self._rows([(cut[j][0], cut[j][1] + a, take, self.next + s) for j, a, take, s in placed])
            self.next += n
            rest = [(cut[j][0], cut[j][1] + a, size) for j, a, size in left]
            self.items = [(self.items[i][0], self.items[i][1] + a, self.items[i][2], self.items[i][3][a : a + size].copy()) for i, a, size in rest]
            self.held = sum(len(x[3]) for x in self.items)
        if last and self.held:  # less than one sequence: lengths that are powers of two need no padding
            filled, room = [], _powers_of_two(self.held, self.room)
            s, free = 0, room[0]
            for i, (_, _, _, ids) in enumerate(self.items):
                p = 0
                while p < len(ids):
                    if not free:
                        s, free = s + 1, room[s + 1]
                    take = min(free, len(ids) - p)
                    filled.append((i, p, take, self.next + s))
                    p, free = p + take, free - take
            yield self._rows(filled)
            self.items, self.held = [], 0


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    room: int = 4096,
    end_id: int = 2,
    linear: float = 1.0,
    quadratic: float = 1.0 / 8192,
    pool_tokens: int = 1 << 20,
) -> DataFrame:
    """Packs every document's ids (and end_id) into sequences of `room` tokens.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens, sequence_id (unique over all partitions), offset in the sequence, cost.
    Each id lies in exactly one piece. All sequences of a partition are full except its last
    ones, whose lengths are powers of two, so that no padding is needed.

    tokenizer: path of a word-level BPE file; every executor must have it. linear, quadratic:
    the cost of a piece of n tokens is linear * n + quadratic * n * n. pool_tokens: how many
    tokens are packed together (at least one sequence's worth); memory follows it and the
    longest text.

    Null or empty texts have the one id end_id. Null ids stay null. Repeated rows are packed
    once each. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer not in _coders:
            _coders[tokenizer] = WordBpe(tokenizer)
        coder = _coders[tokenizer]
        packer = _Packer(room, linear, quadratic, TaskContext.get().partitionId() << 33, max(room, pool_tokens))
        for batch in batches:
            data, off = buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in pieces(off, TEXT_PIECE):
                ids, upto = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for i, doc_id in enumerate(doc_ids[a:b]):
                    own = np.empty(int(upto[i + 1] - upto[i]) + 1, dtype=np.uint16)
                    own[:-1], own[-1] = ids[upto[i] : upto[i + 1]], end_id
                    packer.add(doc_id, own)
                    if packer.held >= packer.pool:
                        yield from packer.flush()
        yield from packer.flush(last=True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
