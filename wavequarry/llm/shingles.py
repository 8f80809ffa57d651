"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textkernel import mix, word_hashes


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles; fewer words than ``size`` are one shingle, no words none."""
    a, b = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)
    for _, words, counts in word_hashes(column):
        n = max(len(words) - size + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled = mix(rolled * a + words[k : k + n] + b)
        for lo, hi in zip(counts[:-1], counts[1:], strict=True):
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                short = np.full(1, np.uint64(hi - lo))
                for w in words[lo:hi]:
                    short = mix(short * b + w + a)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        total = np.uint64(len(tokens)) + mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) * np.uint64(3)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
