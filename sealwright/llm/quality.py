"""Quality by Bradley-Terry pairwise ranking of documents.

A document's strength is linear in its features; in a pair of one good and one bad labelled
document, the good one wins with the logistic of the strengths' difference. Weights maximise the
likelihood of the preference pairs; a logistic curve turns strengths into scores, and documents
are kept above a quantile of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.llm.learn import labelled_rows, logistic, sigmoid
from sealwright.llm.scratch import kept
from sealwright.llm.textbuf import IS_SPACE, buffers, words

_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "beyond_ascii": list(range(128, 256)),
    "control": [b for b in range(32) if not IS_SPACE[b]] + [127],
    "line": [10],
} | {f"sign {chr(b)}": [b] for b in _SIGNS}
FEATURES = ["log words", "log bytes", "word length", "as the word before", "as two words before", *_CLASSES]
_GROUP = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _GROUP[_bytes, _i] = 1
_CHUNK = 256


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text laid end to end; shares are taken as square roots."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        raw, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        size = np.diff(o)
        doc = np.repeat(np.arange(b - a) * 256, size)
        hist = np.bincount(doc + raw, minlength=(b - a) * 256).reshape(-1, 256)
        _, _, w, first = words(raw, o)
        count = np.diff(first)
        at = np.repeat(np.arange(b - a), count)
        again = [np.bincount(at[k:][(w[k:] == w[:-k]) & (at[k:] == at[:-k])], minlength=b - a) for k in (1, 2)]
        per = np.maximum(count, 1)
        out[a:b] = np.column_stack(
            [np.log1p(count), np.log1p(size), size / per / 16, np.sqrt(again[0] / per), np.sqrt(again[1] / per), np.sqrt(hist @ _GROUP / np.maximum(size, 1)[:, None])]
        )
    return out


@dataclass
class QualityModel:
    """strength = ((x - mean) / scale) . weights; score = logistic(slope * strength + base)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    base: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (((features(data, off) - self.mean) / self.scale) @ self.weights) + self.base)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs_each: int = 8, ridge: float = 1.0) -> QualityModel:
    """x: features, y: 1 for good. Each document of the rarer kind meets pairs_each of the other."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 0.02) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    weights, slope, base = np.zeros(len(FEATURES)), 0.0, 0.0
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(good) and len(bad):
        z = (x - mean) / scale
        n = min(len(good), len(bad)) * pairs_each
        rng = np.random.default_rng(11)
        draw = lambda of: np.concatenate([rng.permutation(of) for _ in range(-(-n // len(of)))])[:n]
        weights = logistic(z[draw(good)] - z[draw(bad)], np.ones(n), ridge)
        s = z @ weights
        slope, base = logistic(np.column_stack([s, np.ones(len(s))]), y, 1e-2).tolist()
    elif len(y):
        base = 4.0 if len(good) else -4.0
    return QualityModel(mean, scale, weights, slope, base)


def train_quality(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", most: int = 6_000) -> QualityModel:
    """Fits on at most `most` labelled documents that pass keep (a condition on doc_id), each with its whole text.

    Features are taken in the tasks, so only their rows reach the driver. Without labels
    of both kinds the model gives every document the same score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled_rows(docs, labels, label, keep, most).mapInArrow(run, "doc_id long, y int, x array<double>")
    sample = rows.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    x = np.array(sample.column("x").to_pylist()).reshape(-1, len(FEATURES))
    return fit_pairs(x, sample.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text.

    A null text is empty; empty texts are scored like any other. Null ids stay null, repeated
    rows are scored once each, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(*buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def quantile_cut(scored: DataFrame, drop_share: float, accuracy: int = 10_000) -> float | None:
    """The drop_share quantile of all scores (approximate to 1/accuracy of the rows); None without rows."""
    return scored.agg(F.percentile_approx("score", drop_share, accuracy)).first()[0]


def mark_best(scored: DataFrame, drop_share: float = 0.1) -> DataFrame:
    """scored with above_cut: at or above the drop_share quantile of all its scores. Scored texts are read once."""
    scored = kept(scored, "scores")
    cut = quantile_cut(scored, drop_share)
    return scored.withColumn("above_cut", F.col("score") >= F.lit(cut).cast("double"))


def keep_best(scored: DataFrame, drop_share: float, accuracy: int = 10_000) -> DataFrame:
    """Rows of score at or above the drop_share quantile of all scores (approximate to 1/accuracy)."""
    cut = quantile_cut(scored, drop_share, accuracy)
    return scored if cut is None else scored.where(F.col("score") >= cut)
