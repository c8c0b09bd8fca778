"""Words, lines and substring hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

A substring's hash is a difference of prefix sums of table[byte] * BASE**position, modulo 2**64,
divided by BASE**start (BASE is odd, so it has an inverse) and mixed. Each is found in constant time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240531).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = -(-n // (1 << 18)) << 18
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """h with every bit dependent on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of any run of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each begins (one more at the end). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar("", pa.string()).cast(texts.type))
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return found, at - at[0]


class Texts:
    """A batch of texts with their words `[^\\x20\\x09-\\x0D]+`."""

    def __init__(self, texts: pa.Array, fold: np.ndarray | None = None):
        self.data, self.at = buffers(texts)
        if fold is not None:
            self.data = fold[self.data]
        self.n = len(self.at) - 1
        n = len(self.data)
        inside = ~SPACE[self.data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        first = self.at[:-1][self.at[:-1] < n]
        starts[first] = inside[first]
        last = self.at[1:][self.at[1:] > 0] - 1
        ends[last] = inside[last]
        self.inside = inside
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        #: Where each text's words begin among all words.
        self.words_at = np.searchsorted(self.start, self.at)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words_at)

    def bytes_hash(self) -> Rolling:
        if not hasattr(self, "_rolling"):
            self._rolling = Rolling(_BYTES[self.data])
        return self._rolling

    def word_hash(self) -> np.ndarray:
        return self.bytes_hash().of(self.start, self.end)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def per_group(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] for each i (values of any trailing shape), as float64."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
