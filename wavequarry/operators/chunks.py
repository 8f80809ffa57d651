"""Signals as tables of chunks, so that no recording has to be one array in one task.

A chunked table has key columns (a record and a channel, say), ``chunk`` from 0 on, ``start`` = chunk * size, and ``samples``: ``size`` of them,
fewer in the last chunk. Work that crosses a border either takes a halo of the next chunks' first samples, or leaves
a small state a chunk that is merged by key. Results do not depend on the size of the chunks.

A null or empty signal has no chunks and no results; null samples count as NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.operators import spectra
from wavequarry.operators.evaluation import INPUT_STEP


def cut(channels: DataFrame, size: int, samples: str = "samples") -> DataFrame:
    """Chunks of arrays of samples, beside all other columns."""
    x = F.transform(samples, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    at = F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / size).cast("int"))
    rows = channels.where(F.size(samples) > 0).withColumn(samples, x)
    return rows.select(*[c for c in channels.columns if c != samples], F.explode(at).alias("chunk"), samples).select(
        *[c for c in channels.columns if c != samples], "chunk", (F.col("chunk").cast("long") * size).alias("start"), F.slice(samples, F.col("chunk") * size + 1, F.lit(size)).alias("samples")
    )


def with_halo(chunks: DataFrame, keys: list[str], size: int, after: int) -> DataFrame:
    """Adds ``ahead``: the ``after`` samples that follow each chunk, fewer at the end. Each chunk hands its first samples to those before it."""
    reach = -(-after // size)
    pieces = [F.struct(F.lit(0).alias("j"), F.col("chunk").alias("of"), F.col("samples").alias("x"))]
    pieces += [F.struct(F.lit(j).alias("j"), (F.col("chunk") - j).alias("of"), F.slice("samples", 1, min(size, after - (j - 1) * size)).alias("x")) for j in range(1, reach + 1)]
    sent = chunks.select(*keys, F.explode(F.array(*pieces)).alias("p")).where("p.of >= 0").select(*keys, F.col("p.of").alias("chunk"), F.struct("p.j", "p.x").alias("p"))
    met = sent.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))  # reach + 1 pieces
    return met.select(*keys, "chunk", (F.col("chunk").cast("long") * size).alias("start"), F.col("p")[0]["x"].alias("samples"), F.flatten(F.transform(F.slice("p", 2, max(reach, 1)), lambda p: p["x"])).alias("ahead"))


def windows(chunks: DataFrame, keys: list[str], size: int, length: int, hop: int) -> DataFrame:
    """Full windows of ``length`` samples every ``hop`` ones: keys, w, x. A window belongs to the chunk that holds its first sample."""
    rows = with_halo(chunks, keys, size, length - 1).withColumn("x", F.concat("samples", "ahead"))
    first = F.pmod(-F.col("start"), F.lit(hop)).cast("int")
    last = F.least(F.size("samples") - 1, F.size("x") - length)
    at = F.when(first <= last, F.sequence(first, last, F.lit(hop)))
    rows = rows.select(*keys, "start", "x", F.explode(at).alias("i"))
    return rows.select(*keys, ((F.col("start") + F.col("i")) / hop).cast("int").alias("w"), F.slice("x", F.col("i") + 1, F.lit(length)).alias("x"))


def _column(b: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return b.column(name)[k].values.to_numpy(zero_copy_only=False).astype(float)


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def features(chunks: DataFrame, keys: list[str], size: int, rate: float, length: float = 0.5, step: float = 0.125) -> DataFrame:
    """keys, w, t (the window's end in seconds) and the window features of :mod:`spectra`, with windows across the borders of chunks."""
    points, hop = round(length * rate), round(step * rate)
    if points < 8 or hop < 1:
        raise ValueError("a window needs 8 samples and a step of one")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own, start = _column(b, "samples", k), b.column("start")[k].as_py()
                x = np.concatenate([own, _column(b, "ahead", k)])
                at = np.arange(-start % hop, min(len(own), len(x) - points + 1), hop)
                for i in range(0, len(at), 512):
                    part = at[i : i + 512]
                    found = spectra.window_features(np.stack([x[a : a + points] for a in part]), rate)
                    same = [pa.concat_arrays([b.column(c).slice(k, 1)] * len(part)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*same, pa.array((start + part) // hop, pa.int32()), pa.array((start + part + points) / rate), *[pa.array(c) for c in found.T]], names=[*keys, "w", "t", *spectra.FEATURES])

    schema = f"{_schema(chunks, keys)}, w int, t double, {', '.join(f'{f} double' for f in spectra.FEATURES)}"
    return with_halo(chunks, keys, size, points - 1).mapInArrow(work, schema)


def density(chunks: DataFrame, keys: list[str], size: int, rate: float, segment: int = spectra.SEGMENT, overlap: int = spectra.OVERLAP) -> DataFrame:
    """keys, bin, frequency, power: the mean power density of overlapping segments, each taken where its first sample is.

    A task sums the spectra of a channel's chunks that it has before it passes them on. Shorter channels are one segment.
    """
    length = chunks.groupBy(*keys).agg(F.max(F.col("start") + F.size("samples")).alias("n"))
    rows = with_halo(chunks, keys, size, segment - 1).join(length, keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, power, count, names = None, None, 0, [*keys, "n", "count", "power"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held, pa.array([count], pa.int64()), pa.array([power.tolist()], pa.list_(pa.float64()))], names=names)

        for b in batches:
            for k in range(b.num_rows):
                n, start = b.column("n")[k].as_py(), b.column("start")[k].as_py()
                own = _column(b, "samples", k)
                x = np.concatenate([own, _column(b, "ahead", k)])
                points = min(segment, n)
                hop = max(points - overlap, 1)
                taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(points) / points)
                same = [b.column(c).slice(k, 1) for c in [*keys, "n"]]
                if held is None or any(not a.equals(c) for a, c in zip(held, same, strict=True)):
                    if count:
                        yield out()
                    held, power, count = same, np.zeros(points // 2 + 1), 0
                for a in range(-start % hop, min(len(own), len(x) - points + 1), hop):
                    part = x[a : a + points]
                    power += np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2
                    count += 1
        if count:
            yield out()

    parts = rows.mapInArrow(work, f"{_schema(chunks, keys)}, n bigint, count bigint, power array<double>")
    bins = parts.select(*keys, "n", "count", F.posexplode("power").alias("bin", "power"))
    total = bins.groupBy(*keys, "n", "bin").agg(F.sum("count").alias("count"), F.sum("power").alias("power"))
    points = F.least(F.lit(segment), F.col("n"))
    squares = F.when(points > 1, 0.375 * points).otherwise(0.0)  # the sum of the squared taper; it has a closed form
    squares = F.when(points == 2, 1.0).otherwise(squares)
    twice = F.when((F.col("bin") > 0) & (2 * F.col("bin") < points), 2.0).otherwise(1.0)
    return total.select(*keys, "bin", (F.col("bin") * (1.0 / (points * F.lit(1.0 / rate)))).alias("frequency"), (twice * F.col("power") / F.col("count") / F.nullif(rate * squares, F.lit(0.0))).alias("power"))


def line_excess(spectrum: DataFrame, keys: list[str], lines: tuple[float, ...] = (50.0, 100.0, 150.0)) -> DataFrame:
    """keys and line50, line100, ...: decibels by which the median density within half a hertz exceeds that of 2 to 5 Hz on either side; null without bins in both."""
    least, p = F.lit(float(np.finfo(float).tiny)), F.col("power")
    measures = []
    for line in lines:
        away = F.abs(F.col("frequency") - line)
        near, flank = F.median(F.when(away <= 0.5, p)), F.median(F.when((away >= 2) & (away <= 5), p))
        known = near.isNotNull() & flank.isNotNull()
        measures.append(F.when(known, 10 * F.log10(F.greatest(near, least) / F.greatest(flank, least))).alias(f"line{line:g}"))
    near_any = [F.abs(F.col("frequency") - line) <= 5 for line in lines]
    inside = near_any[0]
    for c in near_any[1:]:
        inside = inside | c
    return spectrum.where(inside).groupBy(*keys).agg(*measures)


# states of moments ----------------------------------------------------------------------------------------------------


def _moments(n: Column, mean: Column, m2: Column, least: Column, most: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), mean.cast("double").alias("mean"), m2.cast("double").alias("m2"), least.cast("double").alias("least"), most.cast("double").alias("most"))


def _merged(a: Column, b: Column) -> Column:
    """Two states of disjoint samples as one; the squared deviations never come from differences of large sums."""
    n = a["n"] + b["n"]
    step = b["mean"] - a["mean"]
    joined = _moments(n, a["mean"] + step * b["n"] / n, a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n, F.least(a["least"], b["least"]), F.greatest(a["most"], b["most"]))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(joined)


def _folded(states: Column) -> Column:
    null = F.lit(None).cast("double")
    return F.aggregate(states, _moments(F.lit(0), F.lit(0.0), F.lit(0.0), null, null), _merged)


def states(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each chunk: counts of samples, finite ones and zeros, moments of the finite ones, first and last sample."""
    finite = F.filter("samples", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = chunks.withColumn("_f", finite)
    n = F.size("_f")
    mean = F.when(n > 0, F.aggregate("_f", F.lit(0.0), lambda a, v: a + v) / n).otherwise(0.0)
    rows = rows.withColumn("_mean", mean)
    m2 = F.aggregate("_f", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
    return rows.select(
        *keys, "chunk", F.size("samples").cast("long").alias("samples"), F.size(F.filter("samples", lambda v: v == 0)).cast("long").alias("zeros"), _moments(n, F.col("_mean"), m2, F.array_min("_f"), F.array_max("_f")).alias("m"),
        F.col("samples")[0].alias("first"), F.element_at("samples", -1).alias("last"),
    )


def profile(chunks: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, samples, finite_rate, zero_rate, mean, std, least, most, first, last of the samples of each group, ``by`` being some of the keys.

    First and last are those of the first and last channel. States are folded channel by channel, then over the channels of a group.
    """
    rows = states(chunks, keys)
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "m")))  # one small state a chunk
    own = rows.groupBy(*keys).agg(
        F.sum("samples").alias("samples"), F.sum("zeros").alias("zeros"), _folded(F.transform(ordered, lambda s: s["m"])).alias("m"),
        F.min_by("first", "chunk").alias("first"), F.max_by("last", "chunk").alias("last"),
    )
    rest = F.struct(*[F.col(k) for k in keys if k not in by], F.lit(0))
    whole = own.groupBy(*by).agg(
        F.count("*").alias("channels"), F.sum("samples").alias("samples"), F.sum("zeros").alias("zeros"), _folded(F.transform(F.sort_array(F.collect_list(F.struct(rest.alias("k"), "m"))), lambda s: s["m"])).alias("m"),
        F.min_by("first", rest).alias("first"), F.max_by("last", rest).alias("last"),
    )
    return whole.select(
        *by, "channels", "samples", (F.col("m.n") / F.col("samples")).alias("finite_rate"), (F.col("zeros") / F.col("samples")).alias("zero_rate"), F.when(F.col("m.n") > 0, F.col("m.mean")).alias("mean"),
        F.when(F.col("m.n") > 0, F.sqrt(F.col("m.m2") / F.col("m.n"))).alias("std"), F.col("m.least").alias("least"), F.col("m.most").alias("most"), "first", "last",
    )


# runs of equal samples ------------------------------------------------------------------------------------------------


def _pieces(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each chunk: inner ones as (length, times), those at its borders one by one with their value and the sides that are open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = _column(b, "samples", k)
                starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
                length = np.diff(np.concatenate([starts, [len(x)]]))
                inner, times = np.unique(length[1:-1], return_counts=True)
                rows = [(0, int(length[0]), 1, float(x[0]), True, len(length) == 1)]
                rows += [(1, int(n), int(t), None, False, False) for n, t in zip(inner, times, strict=True)]
                if len(length) > 1:
                    rows.append((2, int(length[-1]), 1, float(x[-1]), False, True))
                same = [pa.concat_arrays([b.column(c).slice(k, 1)] * len(rows)) for c in [*keys, "chunk"]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keys, "chunk", "place", "length", "times", "value", "left", "right"])

    return chunks.select(*keys, "chunk", "samples").mapInArrow(work, f"{_schema(chunks, keys)}, chunk int, place int, length bigint, times bigint, value double, left boolean, right boolean")


def runs(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, length, times: how many runs of equal samples have each length; a run may cross any number of chunks. NaN equals nothing."""
    pieces = _pieces(chunks, keys)
    order = W.partitionBy(*keys).orderBy("chunk", "place")
    met = F.col("left") & F.lag("right").over(order) & (F.lag("chunk").over(order) == F.col("chunk") - 1) & (F.lag("value").over(order) == F.col("value")) & ~F.isnan("value")
    # two pieces a chunk at most reach the window
    edges = pieces.where("place <> 1").withColumn("new", F.when(met, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    crossing = edges.groupBy(*keys, "run").agg(F.sum("length").alias("length")).select(*keys, "length", F.lit(1).cast("long").alias("times"))
    return crossing.unionByName(pieces.where("place = 1").select(*keys, "length", "times")).groupBy(*keys, "length").agg(F.sum("times").alias("times"))


def run_summary(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, runs, median_run and transition_rate: the share of neighbouring samples that differ (null for a single sample)."""
    found = runs(chunks, keys)
    order = W.partitionBy(*keys).orderBy("length")
    upto = F.sum("times").over(order)
    all_runs = F.sum("times").over(W.partitionBy(*keys))
    ranked = found.withColumns({"upto": upto, "runs": all_runs})
    low, high = F.floor((F.col("runs") + 1) / 2), F.floor((F.col("runs") + 2) / 2)
    middle = lambda at: F.min(F.when(F.col("upto") >= at, F.col("length")))
    g = ranked.groupBy(*keys).agg(F.max("runs").alias("runs"), middle(low).alias("a"), middle(high).alias("b"), F.sum(F.col("length") * F.col("times")).alias("n"))
    return g.select(*keys, "runs", ((F.col("a") + F.col("b")) / 2.0).alias("median_run"), ((F.col("runs") - 1) / F.nullif(F.col("n") - 1, F.lit(0))).alias("transition_rate"))


def levels(chunks: DataFrame, keys: list[str], step: float = INPUT_STEP) -> DataFrame:
    """keys, levels and step_rate: distinct samples, and the share of them that are whole steps of an input's converter."""
    distinct = chunks.select(*keys, F.explode("samples").alias("v")).distinct()
    ratio = F.col("v") / step
    whole = ~F.isnan("v") & (F.abs(ratio - F.rint(ratio)) <= 2e-3 + 1e-5 * F.abs(F.rint(ratio)))
    return distinct.groupBy(*keys).agg(F.count("*").alias("levels"), F.avg(whole.cast("double")).alias("step_rate"))


def auxiliary_metrics(chunks: DataFrame, keys: list[str], step: float = INPUT_STEP) -> DataFrame:
    """keys, levels, step_rate, least, most, std, median_run, transition_rate of each auxiliary channel."""
    moments = profile(chunks, keys, keys).select(*keys, "least", "most", "std")
    return levels(chunks, keys, step).join(moments, keys).join(run_summary(chunks, keys).drop("runs"), keys)


# notches --------------------------------------------------------------------------------------------------------------


class _Notches:
    """The cascade of notches on one chunk. A pass (to, then fro, for each line) is an affine map of the state that comes in from the neighbour:
    what it leaves for the next neighbour is a part of the chunk's samples and a matrix, which depends on the chunk's length and place only.
    """

    def __init__(self, rate: float, lines: tuple[float, ...]) -> None:
        self.filters = [spectra.notch(line, rate) for line in lines]
        self.width = 4 * len(lines)  # two numbers a pass
        self.matrix = lru_cache(64)(self._matrix)

    def apply(self, x: np.ndarray, first: bool, last: bool, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered columns of x and the states they leave, given those that come in (a column each); ends of a signal are mirrored and begin at rest."""
        left = np.empty_like(states)
        edge = spectra.EDGE
        for k, (b, a) in enumerate(self.filters):
            head = [2 * x[:1] - x[edge:0:-1]] if first else []
            tail = [2 * x[-1:] - x[-2 : -edge - 2 : -1]] if last else []
            x = np.concatenate([*head, x, *tail])
            at = 4 * k
            x, left[at : at + 2] = spectra.run(b, a, x, spectra.rest(b, a)[:, None] * x[0] if first else states[at : at + 2])
            x = x[::-1]
            x, left[at + 2 : at + 4] = spectra.run(b, a, x, spectra.rest(b, a)[:, None] * x[0] if last else states[at + 2 : at + 4])
            x = x[::-1][edge if first else 0 : -edge if last else None]
        return x, left

    def each(self, xs: list[np.ndarray], first: list[bool], last: list[bool], states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """:meth:`apply` to many chunks (a row of states each), those of one length and place together, about a million samples at a time."""
        filtered, left = list(xs), np.zeros((len(xs), self.width))
        alike: dict[tuple, list[int]] = {}
        for k, x in enumerate(xs):
            alike.setdefault((len(x), first[k], last[k]), []).append(k)
        for (n, head, tail), rows in alike.items():
            step = max(1, (1 << 20) // n)
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                y, out = self.apply(np.stack([xs[k] for k in part], axis=1), head, tail, states[part].T)
                left[part] = out.T
                for c, k in enumerate(part):
                    filtered[k] = y[:, c]
        return filtered, left

    def _matrix(self, n: int, first: bool, last: bool) -> np.ndarray:
        return self.apply(np.zeros((n, self.width)), first, last, np.eye(self.width))[1]

    def incoming(self, own: np.ndarray, lengths: list[int]) -> np.ndarray:
        """The states that come into each chunk of a channel (a row each), from those that the chunks' samples leave alone."""
        count = len(own)
        maps = [self.matrix(n, c == 0, c == count - 1) for c, n in enumerate(lengths)]
        into = np.zeros_like(own)
        for at in range(0, self.width, 2):
            to = at % 4 == 0
            for c in range(count - 1) if to else range(count - 1, 0, -1):
                into[c + 1 if to else c - 1, at : at + 2] = own[c, at : at + 2] + maps[c][at : at + 2, : at + 2] @ into[c, : at + 2]
        return into


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def notched(chunks: DataFrame, keys: list[str], size: int, rate: float, lines: tuple[float, ...] = (50.0, 100.0, 150.0)) -> DataFrame:
    """keys, chunk, start, samples without the mains and its multiples: :func:`spectra.notched` of whole signals, whatever the chunks' size (10 or more).

    Samples are read twice, once for the states that they leave (four numbers a line and chunk) and once with the states that come in; only these states
    pass from chunk to chunk, all of a channel's in one task. A last chunk of fewer than ten samples is filtered with the one before it. Signals of
    fewer than ten samples stay as they are; a sample that is not finite makes its whole channel NaN.
    """
    edge = spectra.EDGE
    if not rate > 2 * max(lines):
        raise ValueError(f"the rate must be above {2 * max(lines):g} Hz")
    if size <= edge:
        raise ValueError(f"a chunk needs more than {edge} samples")
    # a row knows from what follows it whether it is the last one that is long enough
    rows = with_halo(chunks, keys, size, edge + 1).where((F.col("chunk") == 0) | (F.size("samples") > edge))
    rows = rows.withColumn("last", F.size("ahead") <= edge).withColumn("x", F.when(F.col("last"), F.concat("samples", "ahead")).otherwise(F.col("samples")))
    rows = rows.select(*keys, "chunk", "last", "x")
    long = F.size("x") > edge
    kinds = _schema(chunks, keys)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notches = _Notches(rate, lines)
        for b in batches:
            xs = [_column(b, "x", k) for k in range(b.num_rows)]
            found = notches.each(xs, [c == 0 for c in b.column("chunk").to_pylist()], b.column("last").to_pylist(), np.zeros((len(xs), notches.width)))[1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, "chunk"]), pa.array([len(x) for x in xs], pa.int32()), _lists(found)], names=[*keys, "chunk", "n", "state"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notches, names = _Notches(rate, lines), [*keys, "chunk"]
        held: list[pa.RecordBatch] = []
        for b in batches:
            # what is held ends where the last channel of this batch begins, which may go on in the next one
            begins = np.flatnonzero(b.column("chunk").to_numpy() == 0)
            if len(begins):
                if held or begins[-1]:
                    yield resolved(notches, names, [*held, b.slice(0, begins[-1])])
                held = [b.slice(begins[-1])]
            else:
                held.append(b)
        if held:
            yield resolved(notches, names, held)

    def resolved(notches: _Notches, names: list[str], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        own = np.array(whole.column("state").to_pylist()).reshape(-1, notches.width)
        begins, lengths = np.flatnonzero(whole.column("chunk").to_numpy() == 0), whole.column("n").to_pylist()
        into = np.zeros_like(own)
        for a, e in zip(begins, [*begins[1:], len(own)], strict=True):
            into[a:e] = notches.incoming(own[a:e], lengths[a:e])
        return pa.RecordBatch.from_arrays([*(whole.column(c).combine_chunks() for c in names), _lists(into)], names=[*names, "into"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notches = _Notches(rate, lines)
        for b in batches:
            xs, at, last = [_column(b, "x", k) for k in range(b.num_rows)], b.column("chunk").to_pylist(), b.column("last").to_pylist()
            rows = [k for k, x in enumerate(xs) if len(x) > edge]
            into = np.array([_column(b, "into", k) for k in rows]).reshape(len(rows), notches.width)
            for k, y in zip(rows, notches.each([xs[k] for k in rows], [at[k] == 0 for k in rows], [last[k] for k in rows], into)[0], strict=True):
                xs[k] = y
            pieces = [(k, at[k] + i // size, x[i : i + size]) for k, x in enumerate(xs) for i in range(0, len(x), size)]
            chunk = np.array([c for _, c, _ in pieces], dtype=np.int32)
            ends = np.cumsum([0, *(len(x) for _, _, x in pieces)])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for _, _, x in pieces])))
            same = [b.column(c).take(pa.array([k for k, _, _ in pieces])) for c in keys]
            yield pa.RecordBatch.from_arrays([*same, pa.array(chunk), pa.array(chunk.astype(np.int64) * size), values], names=[*keys, "chunk", "start", "samples"])

    states_left = rows.where(long).mapInArrow(left, f"{kinds}, chunk int, n int, state array<double>")
    into = states_left.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInArrow(scan, f"{kinds}, chunk int, into array<double>")
    same = [rows[k].eqNullSafe(into[k]) for k in keys]
    met = rows.join(into, [rows["chunk"] == into["chunk"], *same], "left").select(*[rows[c] for c in rows.columns], into["into"])
    return met.mapInArrow(filtered, f"{kinds}, chunk int, start bigint, samples array<double>")
