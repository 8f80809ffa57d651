"""Vectorised helpers on Arrow text columns: byte buffers, word spans and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Word separators: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and leaves other bytes alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _LETTER[FOLD]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for byte strings."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)], dtype=np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a single longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """Running polynomial hash; entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever equal bytes stand."""
    value = (running[ends] - running[starts]) * powers(len(running))[1][starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (one entry more than rows)."""
    n = len(data)
    separator = SEPARATOR[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    edge[1:] |= separator
    starts = np.flatnonzero(edge[:-1] & ~separator)
    edge[:-1][separator] = True
    ends = np.flatnonzero(edge[1:] & ~separator) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, hashes of the words with A-Z lower-cased, and the rows' word offsets."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, counts = words(part, local)
        yield i, span_hash(prefix_hash(part, _FOLDED), starts, ends), counts


def hash_words(texts: list[str]) -> np.ndarray:
    """Hashes of single words given as text, as :func:`word_hashes` has them."""
    return np.concatenate([h for _, h, _ in word_hashes(pa.array(texts, pa.string()))] or [np.zeros(0, np.uint64)])


def text_hashes(data: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """Hashes of the words of one text, letters as they are; taken in pieces that end at a separator, so that only 8 bytes a word last."""
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(at + limit, n)
        while end < n and not SEPARATOR[data[end - 1]]:
            tail = np.flatnonzero(SEPARATOR[data[end : end + limit]])
            end = end + int(tail[0]) + 1 if len(tail) else min(end + limit, n)
        part = data[at:end]
        starts, ends, _ = words(part, np.array([0, len(part)]))
        found.append(span_hash(prefix_hash(part), starts, ends))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
