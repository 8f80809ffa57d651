"""Text quality by a factorisation machine over hashed words, structure statistics and text length.

The score of a text is w0 + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2): all pairwise
interactions of low rank in time linear in the features.

Bound: at most ``SAMPLE`` labelled rows are learned from, chosen by hash. Labels, lang, source and doc_id are
never inputs of a score.

Defined results: null and empty texts have structure statistics of zero and no words; without two classes to
learn from, every text scores the share of positive rows (0.5 without rows); texts of any length are read
whole; a document labelled twice counts once, as good if either label says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fold, logistic, sample
from .scratch import lean, small_batches
from .textkernel import _FOLDED, prefix_hash, slices, span_hash, text_buffer, words

WORD_BITS = 15
WORDS = 1 << WORD_BITS
FACTORS = 4
#: Labelled rows learned from, at most.
SAMPLE = 6_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
STEP_BYTES = 1 << 19

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LOWER = (_ASCII >= 97) & (_ASCII <= 122)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_MARK = (_ASCII > 32) & (_ASCII < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
#: Byte classes whose shares of a text are features.
CLASSES = (_UPPER, _DIGIT, _MARK, _ASCII == 33, _ASCII == 124, np.isin(_ASCII, list(b"#$%&*")), np.isin(_ASCII, list(b"<>{}[]\\/=_@")), np.isin(_ASCII, list(b".,;:")), _ASCII == 10, _ASCII >= 128, _ASCII < 9)
STATISTICS = 2 * (len(CLASSES) + 5) + 2
FEATURES = WORDS + STATISTICS


@dataclass
class Model:
    intercept: float
    linear: np.ndarray
    factors: np.ndarray


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, number of rows, and the features as row, index and value."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, STEP_BYTES):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        size = np.maximum(np.diff(local), 1)
        starts, ends, counts = words(part, local)
        hashes = span_hash(prefix_hash(part, _FOLDED), starts, ends)
        n_words = np.diff(counts)
        row = np.repeat(np.arange(n), n_words)
        bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        pairs, repeats = np.unique(row << WORD_BITS | bucket, return_counts=True)
        word_row, word_index = pairs >> WORD_BITS, pairs & (WORDS - 1)
        value = np.log1p(repeats)
        value /= np.sqrt(np.maximum(np.bincount(word_row, value * value, n), 1e-12))[word_row]
        some = np.maximum(n_words, 1)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        last = part[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        first = part[starts] if len(starts) else np.zeros(0, np.uint8)
        running = np.zeros(len(part) + 1, np.int64)
        shares = []
        for members in CLASSES:
            np.cumsum(members[part], out=running[1:])
            shares.append(np.diff(running[local]) / size)
        per_word = lambda x: np.bincount(row, x, n) / some
        shares += [
            per_word(again),
            np.where(n_words > 0, np.bincount(word_row, minlength=n) / some, 0.0),
            np.minimum(per_word((ends - starts).astype(float)) / 20, 1.0),
            per_word(_MARK[last]),
            per_word(_UPPER[first]),
        ]
        stats = np.stack([*shares, *[np.sqrt(s) for s in shares], np.minimum(np.log1p(size) / 12, 1.0), np.where(n_words > 0, 1.0, 0.0)], axis=1)
        yield (
            i,
            n,
            np.concatenate([word_row, np.repeat(np.arange(n), STATISTICS)]),
            np.concatenate([word_index, np.tile(WORDS + np.arange(STATISTICS), n)]),
            np.concatenate([value, stats.ravel()]),
        )


def margins(model: Model, n: int, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = model.intercept + np.bincount(row, model.linear[index] * value, n)
    for f in range(FACTORS):
        vx = model.factors[f][index] * value
        out += 0.5 * (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = SAMPLE) -> Model:
    chosen = sample(labels, label, fold(F.col("doc_id"), folds) != held_out, most)
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, row, index, value in features(b.column("text")):
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(n + 1))
                index, value = index[order].astype(np.int32), value[order].astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("label").slice(first, n), pa.array([index[at[k] : at[k + 1]].tobytes() for k in range(n)], pa.binary()), pa.array([value[at[k] : at[k + 1]].tobytes() for k in range(n)], pa.binary())],
                    names=["label", "index", "value"],
                )

    rows = texts.mapInArrow(lean(extract), "label int, index binary, value binary").collect()  # SAMPLE rows at most
    rows.sort(key=lambda r: (r["label"], bytes(r["index"]), bytes(r["value"])))  # the order of arrival does not matter
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(FEATURES), np.zeros((FACTORS, FEATURES)))
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    return _fit(np.repeat(np.arange(len(y)), [len(x) for x in index]), np.concatenate(index), np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows]), y)


def _fit(row: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.05, penalty: float = 1e-5) -> Model:
    """Logistic loss by Adam over all rows."""
    names, column = np.unique(index, return_inverse=True)
    n, k = len(y), len(names)
    share = y.mean()
    theta = np.zeros((1 + FACTORS, k))
    theta[1:] = np.random.default_rng(5).normal(0, 0.05, (FACTORS, k))
    b = np.array([np.log(share / (1 - share))])
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b[0] + np.bincount(row, theta[0][column] * value, n)
        sums = []
        for f in range(1, FACTORS + 1):
            vx = theta[f][column] * value
            s = np.bincount(row, vx, n)
            z += 0.5 * (s * s - np.bincount(row, vx * vx, n))
            sums.append((s, vx))
        error = (logistic(z) - y) / n
        by_feature = error[row] * value
        g = np.empty_like(theta)
        g[0] = np.bincount(column, by_feature, k)
        for f, (s, vx) in enumerate(sums, 1):
            g[f] = np.bincount(column, by_feature * (s[row] - vx), k)
        g += penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        gb = error.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    linear, factors = np.zeros(FEATURES, np.float32), np.zeros((FACTORS, FEATURES), np.float32)
    linear[names], factors[:, names] = theta[0], theta[1:]
    return Model(float(b[0]), linear, factors)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the probability of label 1 to documents."""
    plain = small_batches(docs).select(*[c for c in docs.columns if c != name])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.zeros(b.num_rows)
            for first, n, row, index, value in features(b.column("text")):
                z[first : first + n] = margins(model, n, row, index, value)
            yield b.append_column(name, pa.array(logistic(z)))

    return plain.mapInArrow(lean(work), T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
