"""Hashed word and character n-grams and counts of whole texts, and linear models on them.

A text's features are, for each of three kinds (words, pairs of words, four consecutive bytes), the shares
of its n-grams in each of 2**BITS buckets. A linear score is then a sum of three means of weights, which
needs no row of features: a batch is scored by looking up the weight of each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textvec import Texts, mixed, per_group

BITS = 16
SIZE = 3 << BITS
_PAIR = np.uint64(0x9FB21C651E98DF25)
_FOUR = np.uint32(0x85EBCA6B)
COUNTS = ("symbols", "capitals", "digits", "repeats", "dup_lines", "length", "word_length", "short", "stutter")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def grams(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: a bucket for each n-gram of the batch, and where each text's begin (n + 1 places; ends come from the counts)."""
    h = t.word_hash()
    yield (h >> np.uint64(64 - BITS)).astype(np.int32), np.stack([t.words_at[:-1], t.words_at[1:]])
    pair = mixed(h[:-1] * _PAIR + h[1:])
    # a word twice is one n-gram, whatever the word
    yield np.where(h[:-1] == h[1:], np.int32(0), (pair >> np.uint64(64 - BITS)).astype(np.int32)) + np.int32(1 << BITS), np.stack([t.words_at[:-1], np.maximum(t.words_at[1:] - 1, t.words_at[:-1])])
    d = t.data.astype(np.uint32)
    four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24) if len(d) > 3 else d[:0]
    yield ((four * _FOUR) >> np.uint32(32 - BITS)).astype(np.int32) + (2 << BITS), np.stack([t.at[:-1], np.maximum(t.at[1:] - 3, t.at[:-1])])


def linear(t: Texts, weights: np.ndarray) -> np.ndarray:
    """The sum over the kinds of the mean weight of a text's n-grams (0 for none). weights: SIZE, or SIZE x outputs."""
    total = np.zeros((t.n, *weights.shape[1:]))
    for bucket, (start, end) in grams(t):
        w = weights[bucket]
        sums = np.zeros((len(w) + 1, *w.shape[1:]))
        np.cumsum(w, axis=0, out=sums[1:])
        start, end = np.minimum(start, len(w)), np.minimum(end, len(w))
        n = np.maximum(end - start, 1)
        total += (sums[end] - sums[start]) / (n if total.ndim == 1 else n[:, None])
    return total


def sparse(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its buckets and their shares."""
    found: list[list] = [[] for _ in range(t.n)]
    for bucket, (start, end) in grams(t):
        for i in range(t.n):
            own, n = np.unique(bucket[start[i] : end[i]], return_counts=True)
            found[i].append((own, (n / max(1, end[i] - start[i])).astype(np.float32)))
    return [(np.concatenate([x for x, _ in f]), np.concatenate([y for _, y in f])) for f in found]


def base_counts(t: Texts, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = {"n_words": t.n_words, "word_chars": t.count(t.inside & ((t.data & 0xC0) != 0x80)), "n_symbols": t.count(_SYMBOL[t.data])}
    # lines: one begins with each text and after each line feed
    feeds = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.at[:-1], feeds + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(t.n), np.searchsorted(t.at, feeds, side="right") - 1]), kind="stable")
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    end = np.where(last, t.at[owner + 1], np.append(start[1:], 0) - 1)
    seen = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(t.inside, out=seen[1:])
    real = seen[end] > seen[start]
    start, end, owner = start[real], end[real], owner[real]
    key = mixed(t.bytes_hash().of(start, end) ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    by = np.argsort(key, kind="stable")
    again = by[1:][key[by][1:] == key[by][:-1]]
    out["n_dup_lines"] = np.bincount(owner[again], minlength=t.n)
    # windows of words
    h = t.word_hash()
    n = len(h) - window + 1
    covered = np.zeros(len(h) + 1, np.int32)
    if n > 0:
        owner = np.repeat(np.arange(t.n), t.n_words)
        key = np.zeros(n, np.uint64)
        for k in range(window):
            key = key * _PAIR + h[k : k + n]
        whole = owner[:n] == owner[window - 1 :]
        place = np.flatnonzero(whole)
        key = mixed(key[place] ^ mixed(owner[place].astype(np.uint64) + np.uint64(1)))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(place), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        np.add.at(covered, place[twice], 1)
        np.add.at(covered, place[twice] + window, -1)
    flags = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = per_group(flags, t.words_at).astype(np.int64)
    return out


def counts(t: Texts) -> np.ndarray:
    """COUNTS of each text, each of order 1."""
    base = base_counts(t)
    size = np.maximum(np.diff(t.at), 1)
    words = np.maximum(base["n_words"], 1)
    lines = t.count(t.data == 10) + 1
    h = t.word_hash()
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[t.words_at[:-1][t.n_words > 0]] = False
    return np.stack(
        [
            np.minimum(base["n_symbols"] / words, 3.0),
            t.count(_CAPITAL[t.data]) / size * 5,
            t.count(_DIGIT[t.data]) / size * 5,
            base["n_repeat_words"] / words,
            base["n_dup_lines"] / lines,
            np.log1p(base["n_words"]) / 5,
            np.minimum(base["word_chars"] / words, 20) / 5,
            (base["n_words"] < 10).astype(float),
            per_group(again, t.words_at) / words,
        ],
        axis=1,
    )


def rows_of(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, shares and row numbers of all texts together."""
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), np.repeat(np.arange(len(found)), [len(x) for x, _ in found])


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-9)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrated(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset by which sigmoid(slope * score + offset) fits the labels: Platt's scaling by Newton's method. weight: rows that each score stands for."""
    if weight is None:
        weight, spread = np.ones(len(scores)), float(scores.std())
    else:
        spread = float(np.sqrt(np.average((scores - np.average(scores, weights=weight)) ** 2, weights=weight)))
    spread = max(spread, 1e-9)
    x = np.stack([scores / spread, np.ones_like(scores)], axis=1)
    n1, n0 = float(weight @ labels), float(weight @ (1 - labels))
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - target)) + 1e-3 * beta
        beta -= np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2), gradient).clip(-2, 2)
    return float(beta[0] / spread), float(beta[1])


def texts_of(column: pa.Array) -> Texts:
    return Texts(column)
