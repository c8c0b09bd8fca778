"""Quality rules: exact counts, and a logistic regression on hashed word and character n-grams.

The regression is fitted on the driver on a bounded sample of labelled rows (SAMPLE), calibrated on a part
that was left out, and scores whole texts in Arrow batches. A text is kept if it passes the base rules and its
probability of label 1 reaches KEEP. Without rows of both labels every text has probability 1.

A null text counts as empty; it has no words and fails the base rules. Input columns with a result's name give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import apply, parts
from .labelled import Sample, sample
from .textvec import Texts

#: Labelled rows to fit on at most.
SAMPLE = 2400
#: Fixed thresholds: the least probability of label 1; words at least; percent of words in repeated windows at most.
KEEP, LEAST_WORDS, MOST_REPEATED = 0.5, 10, 20
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, t: Texts) -> np.ndarray:
        return features.sigmoid(self.slope * features.linear(t, self.weights) + self.offset)


def fit(rows: Sample, steps: int = 120, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Logistic regression by Adam on four fifths of the rows, with both labels weighing the same; the others calibrate it."""
    if not rows.both():
        return Model(np.zeros(features.SIZE, np.float32), 0.0, 40.0)
    apart = np.arange(len(rows)) % 5 == 4
    if len(set(rows.labels[apart].tolist())) < 2 or len(set(rows.labels[~apart].tolist())) < 2:
        apart = np.zeros(len(rows), bool)
    bucket, share, row = features.rows_of(rows.found)
    y = rows.labels.astype(float)
    weight = np.where(apart, 0.0, np.where(y > 0, 0.5 / max(1, y[~apart].sum()), 0.5 / max(1, (1 - y[~apart]).sum())))
    w, b = np.zeros(features.SIZE), 0.0
    by, by0 = features.Adam(features.SIZE, rate), features.Adam((), rate / 10)
    for _ in range(steps):
        score = np.bincount(row, share * w[bucket], len(rows)) + b
        wrong = weight * (features.sigmoid(score) - y)
        w -= by.step(np.bincount(bucket, share * wrong[row], features.SIZE) + decay * w)
        b -= float(by0.step(wrong.sum()))
    held = apart if apart.any() else ~apart
    score = np.bincount(row, share * w[bucket], len(rows))
    slope, offset = features.calibrated(score[held], rows.labels[held])
    return Model(w.astype(np.float32), slope, offset)


def _scored(model: Model, keep: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                t = Texts(batch.column("text"))
                base = features.base_counts(t)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                p = model.probability(t)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(base[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= keep))],
                    names=[*batch.schema.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"],
                )

    return rows


def judge(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs with COLUMNS. labels: doc_id, quality (0 or 1)."""
    model = fit(sample(docs, labels.select("doc_id", F.col("quality").alias("label")), most))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def rows(batches):
        yield from _scored(sent.value, keep)(batches)

    return apply(docs, rows, COLUMNS)
