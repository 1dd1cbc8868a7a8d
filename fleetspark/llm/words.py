"""Words, word hashes and word n-grams of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; it never spans two texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from fleetspark.llm.common import plain_strings, text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Seeds of the two families of word hashes, and of the factors of their n-grams.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
GRAM_SEEDS = (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
#: Longer words (in bytes) are hashed one by one.
LONG = 64
#: By number of bytes, up to 8: which bits of a block of 8 bytes belong to a word.
_PART = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a list of texts, in order; ``first[d]:first[d + 1]`` are those of text ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the two families are independent. Words go through ``mix`` in blocks of
        8 bytes, each block exclusive-or'ed to what the ones before it made; long ones are hashed by BLAKE2."""
        size = (self.ends - self.starts).astype(np.int64)
        out = mix(np.uint64(SEEDS[family]) + size.astype(np.uint64))
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        blocks = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        at, left, first = np.flatnonzero(size <= LONG), size, self.starts
        left, first = left[at], first[at]
        while len(at):
            out[at] = mix(out[at] ^ (blocks[first] & _PART[np.minimum(left, 8)]))
            on = left > 8
            at, left, first = at[on], left[on] - 8, first[on] + 8
        for i in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8, key=SEEDS[family].to_bytes(8, "little"))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out

    def grams(self, hashes: np.ndarray, k: int, at: np.ndarray | None = None, family: int = 0) -> np.ndarray:
        """The hash of the k words from each position of ``at`` (or from each possible position): the sum of their
        hashes, each times an odd factor of its place."""
        factors = mix(np.uint64(GRAM_SEEDS[family]) + np.arange(k, dtype=np.uint64)) | np.uint64(1)
        n = max(0, len(hashes) - k + 1)
        g = (hashes[:n] if at is None else hashes[at]) * factors[0]
        for j in range(1, k):
            g += (hashes[j : n + j] if at is None else hashes[at + j]) * factors[j]
        return mix(g)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each possible position are of one text."""
        n = max(0, len(self.doc) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : n + k - 1]


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """The words of all texts; ``lower`` folds A-Z first. Null and empty texts have none."""
    data, offsets = text_bytes(plain_strings(texts))
    if lower:
        data = _LOWER[data]
    return spans(data, offsets, ~_SPACE[data])


def letter_runs(texts: pa.Array | pa.ChunkedArray) -> Words:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased."""
    data, offsets = text_bytes(plain_strings(texts))
    data = _LOWER[data]
    inside = (data >= 97) & (data <= 122)
    led = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    inside |= led
    inside[1:] |= led[:-1]
    return spans(data, offsets, inside)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes that are ``inside``; a run never spans two texts."""
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[offsets] = True
    begins = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))) if len(data) else inside
    stops = inside & (edge[1:] | np.concatenate((~inside[1:], [True]))) if len(data) else inside
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    return Words(data, starts, ends, doc, first)
