"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks against limits by length.

Text that repeats itself compresses better than prose of its length, noise compresses worse. A document is rejected when
the ratio of the whole text leaves the band of its length, or when more than a quarter of its full chunks leave theirs.
Base counts (repeated lines and windows among them) reject on their own.

Defined results: null and empty texts have no words and fail the base rule; rows are judged one by one, so repeated rows
and rows that share a doc_id each have a result; a null doc_id is kept; an empty table gives no rows; other columns are
ignored. Windows are compared by 64-bit hashes of their words. A text is hashed and compressed in pieces of a megabyte;
8 bytes a word are held for the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textkernel import mix, text_hashes

LEVEL, CHUNK = 3, 2048
#: UTF-8 bytes below which a band holds, and the least and greatest ratio of compressed to plain bytes of prose so long. Prose of
#: the test tables lies 5 to 20 percent inside; very short texts are mostly frame header and are not judged.
BANDS = (
    (100, 0.0, np.inf), (200, 0.50, 1.20), (400, 0.50, 1.00), (800, 0.48, 0.90), (1600, 0.43, 0.80), (3200, 0.41, 0.75), (6400, 0.385, 0.72),
    (12800, 0.37, 0.70), (25600, 0.36, 0.70), (102400, 0.34, 0.70), (1 << 20, 0.30, 0.70), (np.inf, 0.27, 0.70),
)
#: The same for a chunk, and the share of chunks outside beyond which a document goes.
CHUNK_BAND, CHUNK_SHARE = (0.38, 0.75), 0.25
#: Base rule: fewest words, words of a window, and the percentage of words in repeated windows.
LEAST_WORDS, WINDOW, REPEATED = 10, 5, 20
SEPARATORS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
PIECE = 1 << 20
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_bytes long, ratio double, n_chunks long, n_chunks_outside long"
)


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """How many words stand in windows of ``size`` words that the text has more than once."""
    n = len(hashes) - size + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(0x9DDFEA08EB382D69) + hashes[k : k + n])
    _, name, count = np.unique(rolled, return_inverse=True, return_counts=True)
    edge = np.zeros(n + size, np.int32)
    again = np.flatnonzero(count[name] > 1)
    edge[again] += 1
    edge[again + size] -= 1
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            found += line in seen
            seen.add(line)
    return found


def compressed(data: memoryview) -> int:
    """Bytes of a zstandard frame of the whole, fed in pieces."""
    packer = zstandard.ZstdCompressor(level=LEVEL).compressobj(size=len(data))
    return sum(len(packer.compress(data[k : k + PIECE])) for k in range(0, len(data), PIECE)) + len(packer.flush())


def chunk_ratios(data: memoryview) -> np.ndarray:
    """Ratios of the full chunks; what is left at the end is not judged."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return np.array([len(packer.compress(data[k : k + CHUNK])) / CHUNK for k in range(0, len(data) - CHUNK + 1, CHUNK)])


def verdict(n_bytes: int, ratio: float, n_chunks: int, outside: int) -> bool:
    """Whether the whole and the chunks lie within their bands."""
    low, high = next((low, high) for below, low, high in BANDS if n_bytes < below)
    return low <= ratio <= high and outside <= CHUNK_SHARE * n_chunks


def judge(text: str | None) -> tuple:
    """All columns after doc_id."""
    text = text or ""
    data = text.encode()
    hashes = text_hashes(np.frombuffer(data, np.uint8))
    n, repeats = len(hashes), repeated_words(hashes)
    failed = n < LEAST_WORDS or 100 * repeats > REPEATED * n
    view = memoryview(data)
    ratio = compressed(view) / len(data) if data else 0.0
    ratios = chunk_ratios(view)
    outside = int(((ratios < CHUNK_BAND[0]) | (ratios > CHUNK_BAND[1])).sum())
    chars = len(text) - sum(map(text.count, SEPARATORS))
    kept = not failed and verdict(len(data), ratio, len(ratios), outside)
    return n, chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, kept, len(data), ratio, len(ratios), outside


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdict, kept, and the figures behind it, for every row of doc_id and text."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(judge(t.as_py()) for t in b.column("text")), strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(work, SCHEMA)
