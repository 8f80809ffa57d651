"""Document fingerprints: improbable-feature digests in chained Bloom filters.

Every 64-byte window of a text is a feature; its rarity is how seldom windows of its entropy occur in the
corpus (one histogram of 1,000 entropy classes over all documents). A feature that is the rarest of its
surroundings in at least 16 sliding neighbourhoods of 64 features is selected and hashed into five of the
2,048 bits of a Bloom filter; after 160 features the next filter of the chain begins. Two digests are
compared filter by filter: shared bits beyond those expected by chance, over the most that could be shared.

A digest has three chains: of the selected features; of all distinct 16-byte windows (the whole text when shorter),
if these are 512 at most or fewer than eight features are selected; and of the sixteenth of those windows that their
hash picks, the same in every text. Two digests are compared on the features if both have eight, else on all
short windows if both have these, else on the picked ones, which every digest has.

Defined results: null counts as empty; an empty text has an empty digest, which is like another empty one (1) and
unlike anything else (0). Equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches
from .textkernel import joined, prefix_hash, slices, span_hash, text_buffer

WINDOW = 64
NEIGHBOURS = 64
POPULAR = 16
CLASSES = 1000
#: Entropy classes too plain to tell texts apart (0 to 6 bits are spread over the classes).
PLAIN = 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
SHORT, SHORT_WINDOW = 8, 16
#: Distinct short windows up to which a digest has them all, and the bits of a hash that pick the others.
ALL_SHORT, PICK_BITS = 512, 4
STEP_BYTES = 1 << 18

_counts = np.arange(WINDOW + 1, dtype=np.float64)
_C_LOG_C = np.rint(_counts * np.log2(np.maximum(_counts, 1)) * (1 << 20)).astype(np.int64)
_FULL = 6 * WINDOW * (1 << 20)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class of each 64-byte window. Sums slide: a byte that leaves or enters changes one count."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind, same = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.empty(n, bool)
    for d in range(1, WINDOW):
        equal = np.equal(data[:-d], data[d:], out=same[: n - d]).view(np.uint8)
        ahead[: n - d] += equal
        behind[d:] += equal
    leaves = (_C_LOG_C[:-1] - _C_LOG_C[1:])[ahead[: n - WINDOW]]
    enters = (_C_LOG_C[1:] - _C_LOG_C[:-1])[behind[WINDOW:]]
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _C_LOG_C[np.bincount(data[:WINDOW])].sum()
    np.cumsum(leaves + enters, out=sums[1:])
    sums[1:] += sums[0]
    return (_FULL - sums) * CLASSES // (_FULL + 1)


def _windows_inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie in one row."""
    inside = np.zeros(n + 1, np.int32)
    last = offsets[1:] - WINDOW + 1
    has = last > offsets[:-1]
    np.add.at(inside, offsets[:-1][has], 1)
    np.add.at(inside, last[has], -1)
    return np.cumsum(inside)[:n] > 0


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy class, rarest first, counted over every window of every text; plain classes get CLASSES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for b in batches:
            data, offsets = text_buffer(b.column(0))
            for i, j in slices(offsets, STEP_BYTES):
                part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                classes = entropy_classes(part)
                total += np.bincount(classes[_windows_inside(local, len(part))[: len(classes)]], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["class", "windows"])

    rows = docs.select("text").mapInArrow(count, "class long, windows long").groupBy("class").agg(F.sum("windows").alias("windows")).collect()  # CLASSES rows
    windows = np.zeros(CLASSES, np.int64)
    for r in rows:
        windows[r["class"]] = r["windows"]
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), windows))] = np.arange(CLASSES)
    rank[:PLAIN] = CLASSES
    return rank


def _bloom(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chained filters of the features in order, and the number of features of each."""
    n = len(features)
    chain = np.arange(n) // FILTER_FEATURES
    bits = np.zeros((-(-n // FILTER_FEATURES), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[chain, ((features >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), np.bincount(chain, minlength=len(bits))


Chain = tuple[np.ndarray, np.ndarray]
#: Selected features, all short windows or None, picked short windows.
Digest = tuple[Chain, Chain | None, Chain]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """In the order of their first places."""
    first = np.unique(hashes, return_index=True)[1]
    first.sort()
    return hashes[first]


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    out: list[Digest] = []
    data, offsets = joined(texts)
    for i, j in slices(offsets, STEP_BYTES):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        running = prefix_hash(part)
        chosen = np.zeros(0, np.int64)
        if len(part) >= WINDOW + NEIGHBOURS - 1:
            order = rank[entropy_classes(part)]
            inside = _windows_inside(local, len(part))[: len(order)]
            key = np.where(inside & (order < CLASSES), order, CLASSES).astype(np.int64) << 32 | np.arange(len(order))
            lowest, width = key, 1
            while width < NEIGHBOURS:
                lowest = np.minimum(lowest[:-width], lowest[width:])
                width *= 2
            row = np.searchsorted(local, np.arange(len(lowest)), side="right")
            whole = np.arange(len(lowest)) + NEIGHBOURS - 1 + WINDOW <= local[np.minimum(row, len(local) - 1)]
            lowest = lowest[whole & (lowest >> 32 < CLASSES)]
            chosen = np.flatnonzero(np.bincount(lowest & 0xFFFFFFFF, minlength=1) >= POPULAR)
        hashes = span_hash(running, chosen, chosen + WINDOW)
        split = np.searchsorted(chosen, local)
        for r in range(j - i):
            own = _distinct(hashes[split[r] : split[r + 1]])
            starts = np.arange(local[r], max(local[r] + 1, local[r + 1] - SHORT_WINDOW + 1) if local[r] < local[r + 1] else local[r])
            short = _distinct(span_hash(running, starts, np.minimum(starts + SHORT_WINDOW, local[r + 1])))
            whole = len(short) <= ALL_SHORT or len(own) < SHORT
            # filters take the lower 55 bits
            out.append((_bloom(own), _bloom(short) if whole else None, _bloom(short[short >> np.uint64(64 - PICK_BITS) == 0])))
    return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, on the first kind of windows that tells both texts apart."""
    if min(a[0][1].sum(), b[0][1].sum()) >= SHORT:
        return _chain_likeness(a[0], b[0])
    if a[1] is not None and b[1] is not None:
        return _chain_likeness(a[1], b[1])
    return _chain_likeness(a[2], b[2])


def _chain_likeness(a: Chain, b: Chain) -> float:
    """Each filter of the chain with fewer features against the best of the other, weighted by its features."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[0].view(np.uint64), b[0].view(np.uint64)
    shared = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
    bits_x, bits_y = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    chance = bits_x[:, None] * bits_y[None, :] / FILTER_BITS
    most = np.minimum(bits_x[:, None], bits_y[None, :])
    score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    one, other = float(np.average(score.max(axis=1), weights=a[1])), float(np.average(score.max(axis=0), weights=b[1]))
    return one if a[1].sum() < b[1].sum() else other if b[1].sum() < a[1].sum() else (one + other) / 2


def as_text(d: Digest) -> str:
    """The three chains, each as its number of filters, their features and bits; - for one that is not there."""
    return "/".join("-" if c is None else f"{len(c[1])}:{','.join(map(str, c[1]))}:{base64.b64encode(c[0].tobytes()).decode()}" for c in d)


def fingerprint(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Adds ``fingerprint`` to documents, by a given rarity table or that of the documents themselves."""
    rank = rarity(small_batches(docs)) if rank is None else rank

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield b.append_column("fingerprint", pa.array([as_text(d) for d in digests(texts, rank)], pa.string()))

    plain = docs.select(*[c for c in docs.columns if c != "fingerprint"])
    return plain.mapInArrow(add, T.StructType([*plain.schema.fields, T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """doc_id and text dealt into ranges of doc_id, each with a copy of the row that follows its last one.

    Rows of a range share ``range`` and stand in order; the copy comes last and has ``tail`` set.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("k"))
    bounds = np.unique(np.array(ids.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges) or [0.0]))

    @F.pandas_udf("int")
    def range_of(k):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    first = {r["range"]: r["k"] for r in ids.groupBy(range_of("k").alias("range")).agg(F.min("k").alias("k")).collect()}  # one row a range
    order = sorted(first)
    before = {r: order[i - 1] for i, r in enumerate(order)} if order else {}
    heads = F.create_map(*[F.lit(x) for r in order for x in (first[r], before[r])]) if order else F.create_map().cast("map<bigint,int>")
    rows = docs.select("doc_id", "text", key.alias("k"), range_of(key).alias("range"))
    home = F.struct(F.col("range"), F.lit(0).alias("tail"))
    tail = F.struct(F.element_at(heads, F.col("k")).alias("range"), F.lit(1).alias("tail"))
    placed = rows.withColumn("to", F.explode(F.when(F.element_at(heads, F.col("k")).isNotNull(), F.array(home, tail)).otherwise(F.array(home))))
    return placed.select("doc_id", "text", "k", F.col("to.range").alias("range"), F.col("to.tail").alias("tail")), len(order)


def compare_edits(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Fingerprints each text, its edited text (last quarter replaced from the next document) and their likeness.

    Rows with equal doc_id are ordered by text; null doc_ids come first.
    """
    rank = rarity(small_batches(docs)) if rank is None else rank
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = with_next(docs, 4 * parts)
    dealt = placed.repartition(parts, "range").sortWithinPartitions("range", "tail", "k", F.coalesce("text", F.lit("")))
    kind = dict(docs.dtypes)["doc_id"]

    def results(group: list[tuple[int | None, str]], following: tuple[int | None, str] | None) -> pa.RecordBatch:
        chain = [*group, following] if following else group
        edited = []
        for (_, text), (_, after) in zip(chain, chain[1:], strict=False):
            k = len(text) // 4
            edited.append((text[: len(text) - k] + after[:k]).encode())
        own = digests([t.encode() for _, t in chain], rank)
        changed = digests(edited, rank)
        n = len(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in chain[:n]], pa.int64()),
                pa.array([len(t) for _, t in chain[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array([as_text(d) for d in own[:n]], pa.string()),
                pa.array([as_text(d) for d in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own[:n], own[1:], strict=False)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int | None, str]] = []
        current, size, done = None, 0, False
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), pc.fill_null(b.column("text"), "").to_pylist()
            for doc_id, text, part, is_tail in zip(ids, texts, b.column("range").to_pylist(), b.column("tail").to_pylist(), strict=True):
                if part != current:
                    pending, current, size, done = [], part, 0, False
                if done:
                    continue
                if is_tail or size >= STEP_BYTES:
                    yield results(pending, (doc_id, text))
                    pending, size, done = [], 0, bool(is_tail)
                if not is_tail:
                    pending.append((doc_id, text))
                    size += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(work, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
