"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the presence of n-grams of 3 to 6 characters (A-Z lower-cased, inside a word or with the separator
before it), hashed to 2^18 buckets, all of which are fitted and scored. One pass over the texts stores the buckets of
the labelled ones; in how many texts of either class each bucket occurs gives the log-count ratios. One logistic
regression is fitted on the scaled features of all these rows, its gradients summed over tasks; neither texts nor
features pass through the driver.

Bound: at most ``SAMPLE`` labelled rows are learned from, chosen by hash. Labels, lang, source and doc_id are never
inputs of a score. Settings were compared on folds inside the rows that labels may be learned from. Reruns agree up to
the rounding of sums.

Defined results: null and empty texts have no n-grams and score what the intercept says; without two classes
to learn from, every text scores the share of positive rows (0.5 without rows); texts of any length are
read whole; a document labelled twice counts once, as toxic if either label says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fold, logistic, sample
from .scratch import discard, lean, shared_folder, small_batches, stored
from .textkernel import FOLD, SEPARATOR, prefix_hash, slices, span_hash, text_buffer

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows learned from, at most.
SAMPLE = 20_000
#: What a positive row weighs at most (else as many as there are negative rows for each), the squared penalty, the steps at most, and the slope at which they end.
MOST_WEIGHT, PENALTY, STEPS, FLAT = 12.0, 1e-5, 60, 2e-6
#: Tasks that the bounded sample is dealt to.
TASKS = 8
#: Texts that are added to the counts of each bucket, in the classes' shares: draws the ratios of rare n-grams to zero.
PRIOR = 100.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Bytes of text that are turned into pairs of row and bucket at a time, that make a batch of features, and rows whose slopes are summed at a time.
STEP_BYTES, FEATURE_BYTES, SLOPE_ROWS = 1 << 18, 1 << 20, 256


@dataclass
class Model:
    weights: np.ndarray
    ratio: np.ndarray
    intercept: float


def length(squares: np.ndarray) -> np.ndarray:
    """What a text's weights are divided by, from the sum of its squared ratios; little evidence is not blown up."""
    return np.maximum(np.sqrt(squares), 2.0) / 3


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, and pairs of row and bucket in order, each once."""
    data, offsets = text_buffer(column)
    folded = np.where(SEPARATOR, np.uint8(32), FOLD)
    for i, j in slices(offsets, STEP_BYTES):
        part, local = folded[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        running = prefix_hash(part)
        n = len(part)
        # from each position: the first separator after it, or the end of its row
        stop = np.full(n + 1, n, np.int64)
        cuts = np.flatnonzero(part == 32)
        stop[cuts] = cuts
        stop[local] = local
        stop = np.minimum.accumulate(stop[::-1])[::-1][1:]  # at or after the next position
        row_of = np.repeat(np.arange(j - i), np.diff(local))
        letters = np.append(np.flatnonzero((part & 0xC0) != 0x80), n)  # where characters begin
        found = []
        for size in SIZES:
            starts, ends = letters[:-size], letters[size:]
            inside = ends <= stop[starts]
            starts, ends = starts[inside], ends[inside]
            bucket = (span_hash(running, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            found.append(row_of[starts] << BUCKET_BITS | bucket)
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        yield i, pairs >> BUCKET_BITS, pairs & (BUCKETS - 1)


def log_count_ratios(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each bucket the log of its rate in positive to that in negative texts; ``seen`` has a row a class, ``total`` counts their texts."""
    prior = PRIOR * total / total.sum()
    rate = (seen + prior[:, None]) / (total + prior)[:, None]
    return np.log(rate[1] / rate[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = SAMPLE) -> Model:
    chosen = sample(labels, label, fold(F.col("doc_id"), folds) != held_out, most)
    folder = shared_folder(docs.sparkSession)
    learned = stored(features(small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).repartition(TASKS), folder, "features")
    total, seen = class_counts(learned)
    if not total.all():
        share = total[1] / total.sum() if total.sum() else 0.5
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    ratio = log_count_ratios(seen, total)
    model = fit(learned, ratio, min(MOST_WEIGHT, float(total[0] / total[1])))
    discard(docs.sparkSession, folder, "features")
    return model


def features(rows: DataFrame) -> DataFrame:
    """label and the buckets of text in ascending order, at most BUCKETS a row however long the text is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # buckets take several times the bytes of their texts: batches of few texts keep the worker and the JVM small
            for i, j in slices(text_buffer(whole.column("text"))[1], FEATURE_BYTES):
                b = whole.slice(i, j - i)
                count, found = np.zeros(b.num_rows + 1, np.int64), []
                for first, row, bucket in grams(b.column("text")):
                    count[1:] += np.bincount(first + row, minlength=b.num_rows)
                    found.append(bucket.astype(np.int32))
                values = np.concatenate([*found, np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), pa.array(values))], names=["label", "buckets"])

    return rows.select("label", "text").mapInArrow(lean(work), "label int, buckets array<int>")


def class_counts(learned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts each class has, and in how many of them each bucket occurs (a row a class)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS + 1), np.int32)  # the last column counts texts, of which there are SAMPLE at most
        for b in batches:
            label_of, lists = b.column("label").to_numpy(), b.column("buckets")
            label_at = np.repeat(label_of, np.diff(lists.offsets.to_numpy()))
            for c in (0, 1):
                seen[c, :BUCKETS] += np.bincount(lists.flatten().to_numpy()[label_at == c], minlength=BUCKETS).astype(np.int32)
                seen[c, BUCKETS] += (label_of == c).sum()
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["texts"])

    seen = np.zeros((2, BUCKETS + 1))
    for sums in learned.coalesce(TASKS).mapInArrow(lean(count), "texts binary").toArrow().column("texts"):  # TASKS rows of 2 MB at most
        seen += np.frombuffer(sums.as_buffer(), np.int32).reshape(2, -1)
    return seen[:, BUCKETS], seen[:, :BUCKETS]


def fit(learned: DataFrame, ratio: np.ndarray, weight: float, penalty: float = PENALTY) -> Model:
    """One logistic regression on ratio-scaled presence over all rows; positive rows count ``weight`` times.

    A step is a job: tasks sum the slope over their rows, the driver adds TASKS such sums and moves the weights. Weights
    are sent in single precision and their copies deleted after the step.
    """
    send = learned.sparkSession.sparkContext.broadcast
    ratios = send(ratio)

    def slopes(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
        ratio, w = ratios.value, sent.value.astype(float)
        loss, slope = 0.0, np.zeros(BUCKETS + 2)  # the last are the intercept's and the rows' weights
        for b in (whole.slice(k, SLOPE_ROWS) for whole in batches for k in range(0, whole.num_rows, SLOPE_ROWS)):
            lists, n, y = b.column("buckets"), b.num_rows, b.column("label").to_numpy()
            row, bucket = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            value = ratio[bucket]
            value = value / length(np.bincount(row, value * value, n))[row]
            z = np.bincount(row, w[bucket] * value, n) + w[-1]
            counts = np.where(y == 1, weight, 1.0)
            error = (logistic(z) - y) * counts
            loss += float((counts * (np.logaddexp(0, z) - y * z)).sum())
            slope[:BUCKETS] += np.bincount(bucket, error[row] * value, BUCKETS)
            slope[BUCKETS:] += error.sum(), counts.sum()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["task", "loss", "slope"])

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        w = w.astype(np.float32)
        sent = send(w)
        # as Arrow, TASKS rows of 2 MB at most: as row objects they would be copied several times over in the driver
        parts = learned.coalesce(TASKS).mapInArrow(lean(partial(slopes, sent=sent)), "task long, loss double, slope binary").toArrow()
        sent.destroy(blocking=True)
        w = w.astype(float)
        loss, slope = 0.0, np.zeros(BUCKETS + 2)
        for k in np.argsort(parts.column("task").to_numpy()).tolist():
            loss += parts.column("loss")[k].as_py()
            slope += np.frombuffer(parts.column("slope")[k].as_buffer())
        rows = slope[-1]
        return loss / rows + penalty / 2 * float(w[:-1] @ w[:-1]), slope[:-1] / rows + penalty * np.append(w[:-1], 0.0)

    w = descend(at, np.zeros(BUCKETS + 1))
    ratios.destroy()
    return Model((w[:-1] * ratio).astype(np.float32), ratio, float(w[-1]))


def descend(at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = STEPS, kept: int = 10) -> np.ndarray:
    """The least of a convex function, ``at`` giving its value and slope, by limited-memory quasi-Newton steps that are halved until it falls enough."""
    value, slope = at(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() < FLAT:
            break
        way, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / np.linalg.norm(slope)
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            way += s * (share - (y @ way) / (s @ y))
        size = 1.0
        new, new_slope = at(w - way)
        while new > value - 1e-4 * size * (slope @ way) and size > 1e-6:
            size /= 2
            new, new_slope = at(w - size * way)
        if new >= value:  # no fall beyond rounding
            break
        move = (-size * way, new_slope - slope)
        if move[0] @ move[1] > 0:
            moves = [*moves, move][-kept:]
        w, value, slope = w - size * way, new, new_slope
    return w


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the probability of label 1 to documents."""
    weights, squares, intercept = model.weights, np.square(model.ratio), model.intercept
    plain = small_batches(docs).select(*[c for c in docs.columns if c != name])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for first, row, bucket in grams(b.column("text")):
                total += np.bincount(first + row, weights[bucket], b.num_rows)
                n += np.bincount(first + row, squares[bucket], b.num_rows)
            yield b.append_column(name, pa.array(logistic(intercept + total / length(n))))

    return plain.mapInArrow(lean(work), T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
