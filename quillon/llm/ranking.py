"""Quality classifier by Bradley-Terry pairwise ranking.

Each labelled row of quality 1 is preferred over each row of quality 0. A document's strength is linear in its
features (hashed n-grams and counts). The logistic loss of the differences of strengths, over all these pairs
of all labelled rows, is minimised by Adam: a step takes two passes over the rows' features in a scratch table,
one for the distribution of either label's strengths (GRID), one for the gradient, which needs of the other
label's rows their distribution only. The threshold is the quantile of all labelled rows' strengths that the
balance of the two labels asks for; the score is the logistic of the distance from it. Without rows of both
labels every score is 1 if label 1 was seen or nothing was, else 0.

A null text counts as empty and is scored as such. Input columns with a result's name give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import apply, parts, release, scratch
from .labelled import Packed, stored, summed
from .textvec import Texts

#: Steps of the fit, each over all labelled rows.
STEPS = 24
#: Strengths by which rows are counted: a row is shared between the two nearest, and those beyond the ends count as there.
GRID = np.arange(-64, 64, 1 / 32)


@dataclass
class Ranking:
    weights: np.ndarray
    dense: np.ndarray
    threshold: float
    scale: float

    def score(self, t: Texts) -> np.ndarray:
        return features.sigmoid(self.scale * (features.linear(t, self.weights) + features.counts(t) @ self.dense - self.threshold))


def strengths(rows: Packed, weights: np.ndarray, dense: np.ndarray) -> np.ndarray:
    return rows.linear(weights) + rows.counts @ dense


def spread(strength: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows of label 0, then of label 1, by GRID."""
    x = np.clip((strength - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1)
    at = np.minimum(x.astype(np.int64), len(GRID) - 2)
    place, more = at + len(GRID) * labels, x - at
    return np.bincount(place, 1 - more, 2 * len(GRID)) + np.bincount(place + 1, more, 2 * len(GRID))


def losses(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By GRID, the slope of the mean loss over all pairs for a row of label 0, and for one of label 1. found: as from spread()."""
    bad, good = found.reshape(2, -1)
    out = []
    for own, other, sign in ((bad, good, 1.0), (good, bad, -1.0)):
        at = np.flatnonzero(other)
        out.append(sign * features.sigmoid(sign * (GRID[:, None] - GRID[at])) @ (other[at] / other.sum()) / own.sum())
    return out[0], out[1]


def threshold(found: np.ndarray) -> float:
    """The median of the strengths, where rows of either label weigh the same together."""
    bad, good = found.reshape(2, -1)
    below = np.cumsum(bad / bad.sum() + good / good.sum()) / 2
    return float(GRID[np.argmax(below >= 0.5 - 1e-6)] + GRID[np.argmax(below > 0.5 + 1e-6)]) / 2


def fit(rows: DataFrame, steps: int = STEPS, rate: float = 0.3, decay: float = 1e-4) -> Ranking:
    """rows: as from labelled.stored()."""
    context = rows.sparkSession.sparkContext
    seen = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(seen) < 2:
        flat = -1.0 if seen == {0} else 1.0
        return Ranking(np.zeros(features.SIZE, np.float32), np.zeros(len(features.COUNTS)), -40.0 * flat, 1.0)
    w, v = np.zeros(features.SIZE), np.zeros(len(features.COUNTS))
    by, by_dense = features.Adam(features.SIZE, rate), features.Adam(len(v), rate / 3)

    def distribution(sent) -> np.ndarray:
        return summed(rows, 2 * len(GRID), lambda x: spread(strengths(x, *sent.value), x.labels))

    def gradient(sent, slopes) -> np.ndarray:
        def of(x: Packed) -> np.ndarray:
            strength = strengths(x, *sent.value)
            own = np.where(x.labels == 1, *(np.interp(strength, GRID, s) for s in reversed(slopes)))
            return np.concatenate([x.gathered(own), x.counts.T @ own])

        return summed(rows, features.SIZE + len(v), of)

    for step in range(steps + 1):
        sent = context.broadcast((w, v))  # of fixed size
        found = distribution(sent)
        if step < steps:
            g = gradient(sent, losses(found))
            w = w - by.step(g[: features.SIZE] + decay * w)
            v = v - by_dense.step(g[features.SIZE :] + 1e-4 * v)
        sent.unpersist()
    cut = threshold(found)
    slope, _ = features.calibrated(np.tile(GRID, 2) - cut, np.repeat([0, 1], len(GRID)), found)
    return Ranking(w.astype(np.float32), v, cut, max(slope, 1e-3))


def _scored(model: Ranking):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                p = model.score(Texts(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows


def classify(docs: DataFrame, labels: DataFrame, steps: int = STEPS) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted. labels: doc_id, quality (0 or 1), for those rows only that may be learnt from."""
    spark = docs.sparkSession
    before = scratch(spark)
    model = fit(stored(docs, labels.select("doc_id", F.col("quality").alias("label"))), steps)
    release(spark, [p for p in scratch(spark) if p not in before])
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def rows(batches):
        yield from _scored(sent.value)(batches)

    return apply(docs, rows, "score double, predicted int")
