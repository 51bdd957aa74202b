"""Toxicity by a linear-chain conditional random field over words.

Every word is tagged toxic or not. A word's features are itself, its first letters, and the words before and after it, each
hashed to one of SLOTS weights; the chain joins neighbouring tags. Forward-backward gives each word's marginal
probability of being toxic; the marginals make the document's score, and words of high marginal its offending spans.

Only documents are labelled: a toxic one has a toxic word at least, a clean one has none. Weights and chain maximise the
likelihood of that, so the expected tags of a toxic text are those of forward-backward under the constraint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealwright.llm.learn import labelled_rows, logistic, sigmoid
from sealwright.llm.scratch import kept
from sealwright.llm.textbuf import BYTE_CODE, LOWER, U64, buffers, distinct, hash_ranges, mix, pieces, words

_IS_SIGN = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_ROW = 1024  # most words of a row of the blocked recursion
SLOTS = 1 << 18
HEADS = (4, 5, 6)  # bytes of a word's beginnings that are features
NEAR = 0.3  # value of a neighbour's feature; a word's own have 1
PIECE = 1 << 20  # bytes of text whose words a task tags at once


def _lowered(data: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20  # capitals of Latin-1
    return low


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + U64((kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(46)).astype(np.int64)


@dataclass
class Words:
    """The words of some texts: where each begins and ends, which different word it is, and each text's first; of every
    different word, the slots of its own features (SLOTS: none), and its slots as the word before and after another."""

    starts: np.ndarray
    ends: np.ndarray
    which: np.ndarray
    first: np.ndarray
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @property
    def inside(self) -> np.ndarray:
        """Words that have one before them in their text."""
        out = np.ones(len(self.which), dtype=bool)
        out[self.first[:-1][self.first[:-1] < len(out)]] = False
        return np.flatnonzero(out)


def read_words(data: np.ndarray, off: np.ndarray) -> Words:
    """Splits texts into words; signs at a word's ends aren't part of its features, a bare sign has none."""
    starts, ends, h, first = words(data, off)
    sample, which = distinct(h)
    order = np.argsort(starts[sample], kind="stable")  # ranges are hashed in ascending order
    place = np.empty(len(sample), dtype=np.int64)
    place[order] = np.arange(len(sample))
    sample, which = sample[order], place[which]
    low = _lowered(data)
    n = len(data)
    letter = ~_IS_SIGN[data]
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1] if n else at
    preceding = np.maximum.accumulate(np.where(letter, at, -1)) if n else at
    s = np.minimum(following[starts[sample]], ends[sample])
    e = np.maximum(preceding[ends[sample] - 1] + 1, s)
    size = e - s
    own = np.full((len(sample), 1 + len(HEADS)), SLOTS, dtype=np.int64)
    real = np.flatnonzero(size > 0)
    bare = hash_ranges(low, s[real], e[real])
    own[real, 0] = _slots(bare, 0)
    for i, k in enumerate(HEADS, 1):
        x = np.flatnonzero(size > k)
        own[x, i] = _slots(hash_ranges(low, s[x], s[x] + k), i)
    before, after = np.full(len(sample), SLOTS), np.full(len(sample), SLOTS)
    before[real], after[real] = _slots(bare, 10), _slots(bare, 11)
    return Words(starts, ends, which, first, own, before, after)


@dataclass
class Chain:
    """Log potentials: start and trans of tags (0 clean, 1 toxic); toxic words add their features' weights."""

    start: np.ndarray
    trans: np.ndarray
    bias: float

    def passes(self, emit: np.ndarray, first: np.ndarray):
        """Scaled forward and backward values (2 x words) of all chains; first: each chain's first word.

        Words are laid out in rows; each row's 2 x 2 product is taken for all rows at once, the
        rows are joined one by one, and the values follow for all rows at once. A chain's first
        word forgets what stands before it, so chains of any length share rows.
        """
        n = len(emit)
        width = min(_ROW, max(16, 1 << (n.bit_length() // 2)))
        rows = -(-n // width)
        g = np.ones(rows * width)
        g[:n] = np.exp(np.clip(emit, -30, 30))
        head = np.zeros(rows * width, dtype=bool)
        head[first[first < n]] = True
        head[0] = head[n:] = True
        t, s = np.exp(self.trans), np.exp(self.start)
        m00, m10 = np.where(head, s[0], t[0, 0]), np.where(head, s[0], t[1, 0])
        m01, m11 = np.where(head, s[1], t[0, 1]) * g, np.where(head, s[1], t[1, 1]) * g
        m00, m01, m10, m11 = (np.ascontiguousarray(m.reshape(rows, width).T) for m in (m00, m01, m10, m11))
        a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for i in range(width):
            a, b, c, d = a * m00[i] + b * m10[i], a * m01[i] + b * m11[i], c * m00[i] + d * m10[i], c * m01[i] + d * m11[i]
            z = 1.0 / (a + b + c + d)
            a, b, c, d = a * z, b * z, c * z, d * z
        f0, f1 = np.empty(rows), np.empty(rows)
        b0, b1 = np.empty(rows), np.empty(rows)
        x, y = 1.0, 0.0
        for r in range(rows):
            f0[r], f1[r] = x, y
            x, y = x * a[r] + y * c[r], x * b[r] + y * d[r]
            x, y = x / (x + y), y / (x + y)
        x, y = 0.5, 0.5
        for r in range(rows - 1, -1, -1):
            b0[r], b1[r] = x, y
            x, y = a[r] * x + b[r] * y, c[r] * x + d[r] * y
            x, y = x / (x + y), y / (x + y)
        fwd, bwd = np.empty((2, width, rows)), np.empty((2, width, rows))
        for i in range(width):
            f0, f1 = f0 * m00[i] + f1 * m10[i], f0 * m01[i] + f1 * m11[i]
            z = 1.0 / (f0 + f1)
            f0, f1 = f0 * z, f1 * z
            fwd[0, i], fwd[1, i] = f0, f1
        for i in range(width - 1, -1, -1):
            bwd[0, i], bwd[1, i] = b0, b1
            b0, b1 = m00[i] * b0 + m01[i] * b1, m10[i] * b0 + m11[i] * b1
            z = 1.0 / (b0 + b1)
            b0, b1 = b0 * z, b1 * z
        flat = lambda v: np.stack([np.ascontiguousarray(v[k].T).reshape(-1)[:n] for k in (0, 1)])
        return flat(fwd), flat(bwd), g[:n], head[:n]

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's probability of the toxic tag."""
        if not len(emit):
            return np.zeros(0)
        f, b, _, _ = self.passes(emit + self.bias, first)
        return f[1] * b[1] / (f[0] * b[0] + f[1] * b[1])


def expected(chain: Chain, emit: np.ndarray, first: np.ndarray):
    """(marginals, joint probabilities of neighbouring tags (4 x words, the first of each chain unused), log probability of each
    chain being all clean) for emissions that hold the bias already; first: each chain's first word and the end."""
    f, b, g, head = chain.passes(emit, first[:-1])
    post = f[1] * b[1] / (f[0] * b[0] + f[1] * b[1])
    t = np.exp(chain.trans)
    before = np.concatenate([np.ones((2, 1)), f[:, :-1]], axis=1)
    joint = np.stack([before[j] * t[j, k] * (g if k else 1.0) * b[k] for j in (0, 1) for k in (0, 1)])
    joint /= joint.sum(axis=0)
    # all clean: the first tag, then each one given a clean one before it
    alone = 1.0 - post
    alone[~head] = joint[0][~head] / np.maximum(joint[0] + joint[1], 1e-300)[~head]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return post, joint, np.bincount(doc, weights=np.log(np.maximum(alone, 1e-300)), minlength=len(first) - 1)


def _pull(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How much a text's expected counts under the constraint exceed those without it, as a share of the latter:
    -1 for a clean text, P(all clean) / P(some toxic) for a toxic one."""
    p = np.exp(np.minimum(clean, -1e-12))
    return np.where(toxic, p / np.maximum(1.0 - p, 1e-12), -1.0)


def fit(batches: list[tuple[Words, np.ndarray]], epochs: int = 16, least_steps: int = 300, rate: float = 1.0, ridge: float = 0.002) -> tuple[Chain, np.ndarray]:
    """Chain and weights that maximise the likelihood of documents' labels, by Adagrad over batches of (words, labels)."""
    epochs = max(epochs, -(-least_steps // max(1, len(batches))))
    mean = max(1.0, sum(len(w.which) for w, _ in batches) / max(1, sum(len(y) for _, y in batches)))
    start = -math.log(mean) - 1.0
    theta, weights = np.array([0.0, start, 0.0, start, 0.0, start]), np.zeros(SLOTS + 1)
    seen, seen_w = np.full(6, 1.0), np.full(SLOTS + 1, 0.1)
    for epoch in range(epochs):
        for w, y in batches:
            if not len(w.which):
                continue
            chain = Chain(theta[:2], theta[2:].reshape(2, 2), 0.0)
            post, joint, clean = expected(chain, emissions(w, weights), w.first)
            doc = np.repeat(np.arange(len(y)), np.diff(w.first))
            pull = _pull(clean, y == 1)
            g = pull[doc] * post
            inside = w.inside
            head = np.ones(len(doc), dtype=bool)
            head[inside] = False
            own = np.bincount(w.which, weights=g, minlength=len(w.own))
            grad = np.bincount(w.own.reshape(-1), weights=np.repeat(own, w.own.shape[1]), minlength=SLOTS + 1)
            grad += NEAR * np.bincount(w.before, weights=np.bincount(w.which[inside - 1], weights=g[inside], minlength=len(w.own)), minlength=SLOTS + 1)
            grad += NEAR * np.bincount(w.after, weights=np.bincount(w.which[inside], weights=g[inside - 1], minlength=len(w.own)), minlength=SLOTS + 1)
            live = np.flatnonzero(grad)
            live = live[live < SLOTS]
            step = grad[live] - ridge * weights[live]
            seen_w[live] += step * step
            weights[live] += rate * step / np.sqrt(seen_w[live])
            # two clean tags in a row and a clean start keep weight 0: only differences count
            step = np.array([0.0, g[head].sum(), 0.0, *((pull[doc] * joint[k])[inside].sum() for k in (1, 2, 3))])
            seen += step * step
            theta += 0.1 * step / np.sqrt(seen)
    return Chain(theta[:2], theta[2:].reshape(2, 2), 0.0), weights


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """The weight of every word's toxic tag: its own features, and those of its neighbours."""
    out = weights[w.own].sum(axis=1)[w.which]
    inside = w.inside
    out[inside] += NEAR * weights[w.before][w.which[inside - 1]]
    out[inside - 1] += NEAR * weights[w.after][w.which[inside]]
    return out


@dataclass
class ToxicityModel:
    chain: Chain
    weights: np.ndarray
    doc_weights: np.ndarray

    def tag(self, data: np.ndarray, off: np.ndarray):
        """(score of each text, word starts, word ends, marginals, first word of each text)."""
        w = read_words(data, off)
        p = self.chain.marginals(emissions(w, self.weights), w.first[:-1]) if len(w.which) else np.zeros(0)
        return sigmoid(doc_features(p, w.first) @ self.doc_weights), w.starts, w.ends, p, w.first


def doc_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a document's marginals come to: constant, log of expected toxic words, chance of any, the highest."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(doc, weights=p, minlength=n)
    miss = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    return np.column_stack([np.ones(n), np.log1p(total), 1 - np.exp(miss), top])


def train(data: np.ndarray, off: np.ndarray, y: np.ndarray, batch_bytes: int = 1 << 18) -> ToxicityModel:
    """Fits weights and chain on whole texts of a labelled sample, and the curve from marginals to scores on every fourth of them, left out before.

    Memory follows the sample's words by a few bytes each, and the words of a batch. Without labels of both kinds all scores are equal.
    """
    model = ToxicityModel(Chain(np.array([0.0, -9.0]), np.array([[0.0, -9.0], [0.0, -9.0]]), 0.0), np.zeros(SLOTS + 1), np.zeros(4))
    if not 0 < y.sum() < len(y):
        if len(y):
            model.doc_weights = np.array([4.0 if y.all() else -4.0, 0, 0, 0])
        return model
    parts = [(data[off[a] : off[b]], off[a : b + 1] - off[a], y[a:b]) for a, b in pieces(off, batch_bytes)]
    aside = [np.arange(len(x)) % 4 == 3 for _, _, x in parts]
    if len(y) < 200 or not 0 < sum(int(x[s].sum()) for (_, _, x), s in zip(parts, aside)):
        aside = [np.zeros(len(x), dtype=bool) for _, _, x in parts]
    batches = []
    for (raw, o, label), out in zip(parts, aside):
        keep = np.repeat(~out, np.diff(o))
        w = read_words(raw[keep], np.concatenate([[0], np.cumsum(np.diff(o)[~out])]))
        batches.append((replace(w, starts=w.starts[:0], ends=w.ends[:0], which=w.which.astype(np.int32)), label[~out]))
    model.chain, model.weights = fit(batches)
    own = any(s.any() for s in aside)
    x, target = [], []
    for (raw, o, label), out in zip(parts, aside):
        _, _, _, p, first = model.tag(raw, o)
        x.append(doc_features(p, first)[out if own else slice(None)])
        target.append(label[out if own else slice(None)])
    model.doc_weights = logistic(np.concatenate(x), np.concatenate(target).astype(float), 1e-1)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", most: int = 8_000, most_bytes: int = 64 << 20) -> ToxicityModel:
    """Fits on at most `most` labelled documents that pass keep (a condition on doc_id), each with its whole text.

    The texts go to the driver, so they are bounded too: of the chosen ids, in the order of their hash, those whose texts sum to at most
    most_bytes. Of rows that share an id the smallest text counts.
    """
    chosen = labelled_rows(docs, labels, label, keep, most).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    chosen = kept(chosen, "labelled")
    # at most `most` rows without texts
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fit = chosen.select("doc_id", upto.alias("upto")).where(F.col("upto") <= most_bytes).select("doc_id")
    sample = chosen.join(F.broadcast(fit), "doc_id").toArrow().sort_by("doc_id")
    return train(*buffers(sample.column("text")), sample.column("y").to_numpy())


def _spans(data, begin, starts, ends, p, least):
    """Runs of words of marginal at least `least`: code point offsets in the text, and the highest marginal."""
    out, last = [], -2
    for i in np.flatnonzero(p >= least).tolist():
        a, b = int(starts[i]), int(ends[i])
        if i == last + 1:
            out[-1][1], out[-1][2] = b, max(out[-1][2], float(p[i]))
        else:
            out.append([a, b, float(p[i])])
        last = i
    if not out:
        return []
    points = np.concatenate([[0], np.cumsum((data[begin : out[-1][1]] & 0xC0) != 0x80)])
    return [{"begin": int(points[a - begin]), "end": int(points[b - begin]), "marginal": m} for a, b, m in out]


def _texts_of(batches, at: int):
    """Slices of batches of about PIECE bytes of text (column at), one row at least, with that text's bytes and offsets: what a
    task holds and gives back at once doesn't grow with a batch."""
    for batch in batches:
        data, off = buffers(batch.column(at))
        for a, b in pieces(off, PIECE):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]


def _sift(batches, at: int, model: ToxicityModel, below: float):
    """Rows whose text (column at) scores under below."""
    for rows, data, off in _texts_of(batches, at):
        yield rows.filter(pa.array(model.tag(data, off)[0] < below))


SCORED = "doc_id long, score double, toxic_words double, spans array<struct<begin:long,end:long,marginal:double>>"


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, keep_rows: bool = False, below: float | None = None) -> DataFrame:
    """doc_id, score (0 to 1), toxic_words (the marginals' sum) and spans (offsets in code points) of every whole text.

    keep_rows: instead, the rows of docs whose score is under `below`, with their own columns.
    A null text is empty; empty texts have a score like any other. Null ids stay null, repeated
    rows are scored once each, an empty table gives no rows, other columns are ignored.
    least: the marginal from which a word is part of a span.
    """
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in _texts_of(batches, 1):
            n = rows.num_rows
            score, starts, ends, p, first = model.tag(data, off)
            total = np.bincount(np.repeat(np.arange(n), np.diff(first)), weights=p, minlength=n)
            spans = [_spans(data, int(off[i]), starts[x:y], ends[x:y], p[x:y], least) if total[i] >= least else [] for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(total), pa.array(spans, kind)], ["doc_id", "score", "toxic_words", "spans"])

    if keep_rows:
        text_at = docs.columns.index(text_col)
        return docs.mapInArrow(lambda batches: _sift(batches, text_at, model, below), docs.schema)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)
