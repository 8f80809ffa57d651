"""Window features of long recordings, mains noise and channel roles: NumPy kernels inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavequarry.functions import naming
from wavequarry.functions.arrays import TINY

#: Bands in hertz (lower end included), mains frequency and half the width that is left out around its multiples.
BANDS = {"low": (1, 13), "beta": (13, 30), "low_gamma": (30, 80), "high_gamma": (80, 150), "ripple": (150, 250), "fast_ripple": (250, 500.1)}
MAINS, GAP = 50.0, 2.0
FEATURES = ["line_length", "rms_change", "teager_energy", "kurtosis", *(f"{b}_power" for b in BANDS if b != "low"), "high_low_ratio", "low_frequency_suppression", "spectral_centroid", "spectral_entropy_change", "rhythmicity"]
SEGMENT, OVERLAP = 4000, 2000
#: Decibels from which noise is severe, channels a record keeps at least, quality of the notches, and samples mirrored at either end.
SEVERE, LEAST_LEFT, QUALITY, EDGE = 20.0, 10, 50.0, 9


def clean(frequency: np.ndarray, highest: float) -> np.ndarray:
    """Which frequencies from 1 Hz on lie away from the multiples of the mains."""
    keep = (frequency >= 1) & (frequency <= highest)
    for line in np.arange(MAINS, max(highest, MAINS) + 1e-9, MAINS):
        keep &= np.abs(frequency - line) > GAP
    return keep


def window_features(x: np.ndarray, rate: float) -> np.ndarray:
    """FEATURES of windows (one a row), in their order."""
    lg = lambda v: np.log(np.maximum(v, TINY))
    x = x - x.mean(axis=1, keepdims=True)
    n = x.shape[1]
    square = x * x
    second = square.mean(axis=1)
    out = [lg(np.abs(np.diff(x)).mean(axis=1)), lg(np.sqrt(second)), lg(np.abs(square[:, 1:-1] - x[:, :-2] * x[:, 2:]).mean(axis=1)), lg((square * square).mean(axis=1) / np.maximum(second * second, TINY))]
    power = np.abs(np.fft.rfft(x * np.hanning(n), axis=1)) ** 2
    frequency = np.fft.rfftfreq(n, 1 / rate)
    total = {}
    for name, (low, high) in BANDS.items():
        mask = clean(frequency, high) & (frequency >= low) & (frequency < high)
        if not mask.any():
            raise ValueError(f"no frequency of band {name} at {rate} Hz and {n} samples")
        total[name] = power[:, mask].sum(axis=1) * frequency[1]
    out += [lg(total[b]) for b in BANDS if b != "low"]
    out += [lg(total["beta"] + total["low_gamma"] + total["high_gamma"]) - lg(total["low"]), -lg(total["low"])]
    wide = clean(frequency, 250)
    p = power[:, wide]
    whole = np.maximum(p.sum(axis=1), TINY)
    share = p / whole[:, None]
    out += [(p * frequency[wide]).sum(axis=1) / whole, -(share * np.log(np.maximum(share, TINY))).sum(axis=1) / np.log(wide.sum())]
    slow = (frequency >= 1) & (frequency < 45)
    return np.column_stack([*out, lg(power[:, slow].max(axis=1) / np.maximum(power[:, slow].sum(axis=1), TINY))])


def features(channels: DataFrame, rate: float, length: float = 0.5, step: float = 0.125, samples: str = "samples") -> DataFrame:
    """A row (all other columns, t, FEATURES) for each full window of each channel; t is the window's end in seconds.

    A channel shorter than a window has no rows. Windows of any number pass through a few megabytes at a time.
    """
    size, hop = round(length * rate), round(step * rate)
    if size < 8 or hop < 1:
        raise ValueError("a window needs 8 samples and a step of one")
    kept = [f for f in channels.schema.fields if f.name != samples]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = b.column(samples)[k].values
                x = np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False).astype(float)
                if len(x) < size:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
                for at in range(0, len(windows), 512):
                    found = window_features(windows[at : at + 512], rate)
                    n = len(found)
                    own = [pa.concat_arrays([b.column(f.name).slice(k, 1)] * n) for f in kept]
                    t = (np.arange(at, at + n) * hop + size) / rate
                    yield pa.RecordBatch.from_arrays([*own, pa.array(t), *[pa.array(c) for c in found.T]], names=[*[f.name for f in kept], "t", *FEATURES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "t double", *(f"{f} double" for f in FEATURES)])
    return channels.select(*[f.name for f in kept], samples).mapInArrow(work, schema)


def density(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power density of half-overlapping segments without their mean, under a periodic Hann taper."""
    size = min(SEGMENT, len(x))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(size - OVERLAP, 1)]
    power = np.zeros(size // 2 + 1)
    for part in parts:
        power += np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2
    power = power / len(parts) / (rate * (taper * taper).sum())
    power[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def excess(frequency: np.ndarray, power: np.ndarray, line: float) -> float:
    """Decibels by which the median density within half a hertz of a line exceeds that of 2 to 5 Hz on either side."""
    away = np.abs(frequency - line)
    least = np.finfo(float).tiny
    near, flank = power[away <= 0.5], power[(away >= 2) & (away <= 5)]
    return float(10 * np.log10(max(np.median(near), least) / max(np.median(flank), least)))


def line_noise(channels: DataFrame, rate: float, samples: str = "samples") -> DataFrame:
    """All other columns with std, peak_to_peak, zero_rate, repeat_rate, excess at 50, 100 and 150 Hz, and flags; null for channels of fewer than 8 samples."""
    kept = [f for f in channels.schema.fields if f.name != samples]
    names = ["std", "peak_to_peak", "zero_rate", "repeat_rate", "line50", "line100", "line150"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                x = b.column(samples)[k].values
                x = np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False).astype(float)
                if len(x) < 8:
                    rows.append([None] * len(names))
                    continue
                at, power = density(x, rate)
                rows.append([float(x.std()), float(np.ptp(x)), float((x == 0).mean()), float((np.diff(x) == 0).mean()), *(excess(at, power, MAINS * m) for m in (1, 2, 3))])
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *[pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]], names=[*[f.name for f in kept], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])
    found = channels.select(*[f.name for f in kept], samples).mapInArrow(work, schema)
    return found.withColumns({"line50_over_10": F.col("line50") > 10, "line50_over_20": F.col("line50") > 20, "line100_over_10": F.col("line100") > 10})


def without_severe_noise(channels: DataFrame, metrics: DataFrame) -> DataFrame:
    """The channels whose excess at 50 Hz is at most 20 dB, before any features are taken; a record that would keep fewer than ten keeps all.

    channels (sample_id, channel_id, ...) and metrics (sample_id, channel_id, line50), a row a channel; channels without a
    figure stay. Only names pass through the window, samples are joined to the verdicts.
    """
    known = channels.select("sample_id", "channel_id").distinct().join(metrics.select("sample_id", "channel_id", "line50"), ["sample_id", "channel_id"], "left")
    quiet = F.coalesce("line50", F.lit(0.0)) <= SEVERE
    left = F.sum(quiet.cast("int")).over(W.partitionBy("sample_id"))
    goes = known.withColumn("left", left).where(~quiet & (F.col("left") >= LEAST_LEFT)).select("sample_id", "channel_id")
    return channels.join(goes, ["sample_id", "channel_id"], "left_anti")


def noise_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """channels, median and mean excess at 50 Hz and the shares of flagged channels for each group, noisiest first."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    g = metrics.groupBy(*by).agg(
        F.count("*").alias("channels"), F.median("line50").alias("median_50hz_excess_db"), F.avg("line50").alias("mean_50hz_excess_db"),
        rate("line50_over_10").alias("candidate_rate"), rate("line50_over_20").alias("severe_rate"), rate("line100_over_10").alias("harmonic_100hz_rate"),
    )
    return g.orderBy(F.desc("median_50hz_excess_db"), F.desc("channels"), *by)


def notch(line: float, rate: float, quality: float = QUALITY) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a second-order filter that takes out one frequency; its width at half power is line / quality."""
    angle = 2 * np.pi * line / rate
    gain = 1 / (1 + np.tan(angle / quality / 2))
    return gain * np.array([1, -2 * np.cos(angle), 1]), np.array([1, -2 * gain * np.cos(angle), 2 * gain - 1])


@lru_cache(16)
def _steps(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[list[np.ndarray], ...]:
    """Powers of the filter's state, what a block of 256 samples answers to itself and to the state, and what its samples leave in the state."""
    size = 256
    step, into = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    answer = np.array([b[0], *(powers[k][0] @ into for k in range(size - 1))])  # to a single one
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    within = np.where(lag >= 0, answer[np.abs(lag)], 0.0)
    seen = np.array([p[0] for p in powers[:size]])
    left = np.array([p @ into for p in powers[:size]]).T  # what a sample leaves in the state, so many samples later
    return powers, within, seen, left


def rest(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of the filter after a one has always been there."""
    step, into = np.array([[-a[1], 1.0], [-a[2], 0.0]]), b[1:] - a[1:] * b[0]
    return np.linalg.solve(np.eye(2) - step, into)


def run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter along the columns of x from a state (a column each), and the state that it leaves; blocks of 256 samples as matrix products."""
    powers, within, seen, left = _steps(tuple(b), tuple(a))
    out, size = np.empty_like(x), len(within)
    for at in range(0, len(x), size):
        part = x[at : at + size]
        n = len(part)
        out[at : at + n] = within[:n, :n] @ part + seen[:n] @ state
        state = powers[n] @ state + left[:, :n] @ part[::-1]
    return out, state


def forward(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter along one signal, begun as if its first value had always been there."""
    return run(b, a, x[:, None], rest(b, a)[:, None] * x[0])[0][:, 0]


def notched(x: np.ndarray, rate: float, lines: tuple[float, ...] = (50.0, 100.0, 150.0)) -> np.ndarray:
    """The signal without the mains and its multiples, filtered to and fro so that no phase moves; ends are mirrored about their last value."""
    for line in lines:
        b, a = notch(line, rate)
        wide = np.concatenate([2 * x[0] - x[EDGE:0:-1], x, 2 * x[-1] - x[-2 : -EDGE - 2 : -1]])
        x = forward(b, a, forward(b, a, wide)[::-1])[::-1][EDGE:-EDGE]
    return x


def notch_filtered(channels: DataFrame, rate: float, samples: str = "samples") -> DataFrame:
    """Channels with their samples notched, as doubles; signals of fewer than ten samples, and null ones, stay as they are."""
    if not rate > 300:
        raise ValueError("the rate must be above 300 Hz")
    kept = [f for f in channels.schema.fields if f.name != samples]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for v in b.column(samples):
                x = None if v.values is None else v.values.to_numpy(zero_copy_only=False).astype(float)
                found.append(x if x is None or len(x) <= EDGE else notched(x, rate))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(found, pa.list_(pa.float64()))], names=[*[f.name for f in kept], samples])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{samples}` array<double>"])
    return channels.select(*[f.name for f in kept], samples).mapInArrow(work, schema)


def eligible(channels: DataFrame, record: str = "sample_id", label: str = "channel_id", index: str = "channel_index") -> DataFrame:
    """record, channels: the labels of each record that name a contact, in the order of their index."""
    own = channels.where(naming.role(F.col(label)) == "seeg_candidate")
    return own.groupBy(record).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, label))), lambda s: s[label]).alias("channels"))


def auxiliary(channels: DataFrame, label: str = "channel_id") -> DataFrame:
    """Channels of direct-current inputs and of the AC family."""
    return channels.where(F.col(label).rlike(naming.AUXILIARY) | F.col(label).rlike(naming.CURRENT_FAMILY))
