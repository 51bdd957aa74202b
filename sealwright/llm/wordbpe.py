"""Token ids of whole texts by a word-level BPE file of the `tokenizers` library, in bulk.

The ids equal `Tokenizer.encode(text, add_special_tokens=False).ids`. A space or line feed
always ends a word of this tokenizer, and a word's ids don't depend on its neighbours, so each
distinct word of a batch is encoded once. Words of plain Latin letters, digits and signs are merged
many at a time with numpy; any other word goes to the library itself. Words are told apart by a
64-bit hash within their batch.
"""

from __future__ import annotations

import json

import numpy as np

from sealwright.llm.textbuf import LOWER, distinct, gather_ranges, words

_INF = np.int32(1 << 30)
_LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF in UTF-8
_KIND = np.full(256, 2, dtype=np.uint8)  # what the tokenizer splits apart: letters 0, digits 1, signs 2
_KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 0, 1


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE files."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """encode(data, offsets) gives the ids of many texts laid end to end."""

    def __init__(self, path: str):
        """path: the tokenizer's JSON file."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if max(vocab.values()) > 0xFFFF or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("a word-level BPE file with at most 65,536 ids is needed")
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[letters[b] + "</w>"] for b in range(256)], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], dtype=np.uint32)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        _, lowest = np.unique(keys, return_index=True)
        self._build(keys[lowest], lowest.astype(np.int32), made[lowest])

    def _build(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table from a pair of ids to its merge."""
        size = 1 << 18
        self.slot_key = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
        self.slot_rank, self.slot_made = np.full(size, _INF, dtype=np.int32), np.zeros(size, dtype=np.int32)
        todo, probe = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + probe) % size
            free = self.slot_key[at] == 0xFFFFFFFF
            _, first = np.unique(at, return_index=True)
            lucky = np.zeros(len(todo), dtype=bool)
            lucky[first] = True
            put = lucky & free
            self.slot_key[at[put]], self.slot_rank[at[put]], self.slot_made[at[put]] = keys[todo[put]], rank[todo[put]], made[todo[put]]
            todo, probe = todo[~put], probe + 1
        self.probes = probe

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair of ids; where there is none, an empty slot."""
        at = self._slot(keys)
        found = self.slot_key[at]
        todo = np.flatnonzero((found != keys) & (found != 0xFFFFFFFF))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & 0x3FFFF
            found = self.slot_key[at[todo]]
            todo = todo[(found != keys[todo]) & (found != 0xFFFFFFFF)]
        at[todo] = np.flatnonzero(self.slot_key == 0xFFFFFFFF)[0] if len(todo) else 0
        return at

    def merge(self, ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges ids within runs of equal part, each run's pair of lowest rank first."""
        done_part, done_ids = [], []
        while len(ids):
            new = np.empty(len(ids), dtype=bool)
            new[0] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            rank = np.full(len(ids), _INF, dtype=np.int32)
            at = np.flatnonzero(~new[1:])
            slot = self._find((ids[at].astype(np.uint32) << np.uint32(16)) | ids[at + 1].astype(np.uint32))
            rank[at] = self.slot_rank[slot]
            start = np.flatnonzero(new)
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
            over = best == _INF
            done_part.append(part[over])
            done_ids.append(ids[over].astype(np.uint16))
            hit = rank == best
            hit &= ~over
            for i in np.flatnonzero(hit[:-1] & hit[1:]).tolist():  # overlapping equal pairs (aaa): the left one merges
                if hit[i]:
                    hit[i + 1] = False
            chosen = hit[at]
            ids[at[chosen]] = self.slot_made[slot[chosen]]
            over[1:] |= hit[:-1]
            keep = np.flatnonzero(~over)
            ids, part = ids[keep], part[keep]
        if not done_ids:
            return np.zeros(0, np.uint16), part
        flat = np.concatenate(done_part)
        order = np.argsort(flat, kind="stable")
        return np.concatenate(done_ids)[order], flat[order]

    def _plain(self, raw: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n words of plain letters, digits and signs (bytes raw, of word), and how many each has."""
        prev = np.empty_like(raw)
        prev[0], prev[1:] = 0, raw[:-1]
        raw = np.where((prev == _LATIN) & (raw >= 0x80) & (raw <= 0x9E), raw + np.uint8(0x20), LOWER[raw])
        kind = _KIND[raw]
        new = np.empty(len(raw), dtype=bool)
        new[0] = True
        new[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])
        new |= kind == 1
        last = np.append(new[1:], True)
        ids = np.where(last, self.final[raw], self.inner[raw])
        part = (np.cumsum(new) - 1).astype(np.int32)
        out, of = self.merge(ids, part)
        return out, np.bincount(word[np.flatnonzero(new)][of], minlength=n)

    def _vocabulary(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at begin, one after the other, and how many each has."""
        ids, counts = [], []
        bounds = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, 1 << 17), side="right")
        for a, b in zip(bounds, [*bounds[1:], len(begin)]):
            if a == b:
                continue
            raw = data[gather_ranges(begin[a:b], size[a:b])]
            word = np.repeat(np.arange(b - a), size[a:b])
            prev = np.empty_like(raw)
            prev[0], prev[1:] = 0, raw[:-1]
            after = prev == _LATIN
            high = raw >= 0x80
            odd = (raw < 0x21) | (raw == 0x7F) | (raw == 0x27) | (high & (raw != _LATIN) & (~after | (raw >= 0xC0)))
            odd |= after & ((raw == 0x97) | (raw == 0xB7)) | ((raw == 0x7C) & (prev == 0x3C))
            strange = np.bincount(word[odd], minlength=b - a) > 0
            usual = ~strange[word]
            n_of = np.zeros(b - a, dtype=np.int64)
            if usual.any():
                out, n_of = self._plain(raw[usual], word[usual], b - a)
            if strange.any():
                ends = np.cumsum(n_of)
                pieces, at = [], 0
                for i in np.flatnonzero(strange).tolist():
                    text = data[begin[a + i] : begin[a + i] + size[a + i]].tobytes().decode("utf-8", "replace")
                    own = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
                    if usual.any():
                        pieces.append(out[at : ends[i]])
                        at = int(ends[i])
                    pieces.append(own)
                    n_of[i] = len(own)
                out = np.concatenate([*pieces, out[at:]] if usual.any() else pieces)
            ids.append(out)
            counts.append(n_of)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint16), np.zeros(0, np.int64))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint16, where each text's ids begin; one entry more than there are texts)."""
        starts, ends, hashes, first = words(data, off, lower=False)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
        sample, which = distinct(hashes)
        vocab, size = self._vocabulary(data, starts[sample], (ends - starts)[sample])
        begin = np.cumsum(size) - size
        length = size[which]
        upto = np.concatenate([[0], np.cumsum(length)])
        return vocab[gather_ranges(begin[which], length)], upto[first]
