"""Chunked signals: the same results for every length of chunks, and those of NumPy on whole signals."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import chunks, spectra

SIZES = (1, 7, 64, 1000)
KEYS = ["record", "channel"]


def table(spark, signals, size):
    rows = [(k % 2, k, None if x is None else [None if np.isnan(v) else float(v) for v in x]) for k, x in enumerate(signals)]
    return chunks.cut(spark.createDataFrame(rows, "record int, channel int, samples array<double>"), size)


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(4)
    return [rng.normal(size=300), rng.normal(size=91).round(1), np.repeat([1.0, 2, 2, 3], 40), np.array([5.0]), np.array([np.nan, 1, 1, np.nan, np.nan, 2]), np.zeros(130), 366.3 * rng.integers(-2, 3, 200), None, np.zeros(0)]


@pytest.mark.parametrize("size", SIZES)
def test_windows(spark, signals, size):
    got = {(r.channel, r.w): r.x for r in chunks.windows(table(spark, signals, size), KEYS, size, 20, 6).collect()}
    want = {(k, w): x[6 * w : 6 * w + 20].tolist() for k, x in enumerate(signals) if x is not None for w in range((len(x) - 20) // 6 + 1 if len(x) >= 20 else 0)}
    assert got == want


@pytest.mark.parametrize("size", (90, 1000, 5000))
def test_features_and_density(spark, size):
    rng = np.random.default_rng(2)
    long = [rng.normal(size=4321) + np.sin(np.arange(4321) * 2 * np.pi * 50 / 1100), rng.normal(size=900), rng.normal(size=300)]
    rows = table(spark, long, size)
    got = {(r.channel, r.w): r[4:] for r in chunks.features(rows, KEYS, size, 1100.0, 0.5, 0.125).collect()}
    points, hop = 550, 138
    want = {(k, w): tuple(spectra.window_features(x[None, w * hop : w * hop + points], 1100.0)[0]) for k, x in enumerate(long) for w in range((len(x) - points) // hop + 1 if len(x) >= points else 0)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    spectrum = chunks.density(rows, KEYS, size, 1100.0, 1000, 500)
    lines = {r.channel: r for r in chunks.line_excess(spectrum, KEYS).collect()}
    found = {(r.channel, r.bin): r.power for r in spectrum.collect()}
    for k, x in enumerate(long):
        n = min(1000, len(x))
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(n - 500, 1)]
        power = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2).mean(axis=0) / (1100 * (taper**2).sum())
        power[1 : -1 if n % 2 == 0 else None] *= 2
        assert np.allclose([found[k, i] for i in range(len(power))], power, rtol=1e-9)
        assert lines[k].line50 is None if n == 300 else np.isclose(lines[k].line50, spectra.excess(np.fft.rfftfreq(n, 1 / 1100), power, 50.0))
    assert lines[0].line50 > 10 > lines[1].line50


@pytest.mark.parametrize("size", SIZES)
def test_runs_levels_and_profile(spark, signals, size):
    rows = table(spark, signals, size)
    got = {r.channel: r for r in chunks.run_summary(rows, KEYS).collect()}
    level = {r.channel: r for r in chunks.levels(rows, KEYS).collect()}
    stats = {r.channel: r for r in chunks.profile(rows, KEYS, KEYS).collect()}
    for k, x in enumerate(signals):
        if x is None or not len(x):
            assert k not in got and k not in stats
            continue
        length = [len(list(g)) for v, g in itertools.groupby(x) if v == v] + [1] * int(np.isnan(x).sum())
        assert (got[k].runs, got[k].median_run) == (len(length), np.median(length))
        assert got[k].transition_rate is None if len(x) == 1 else np.isclose(got[k].transition_rate, (np.diff(x) != 0).mean())
        distinct = np.unique(x)
        ratio = distinct / 366.3
        assert level[k].levels == len(distinct) and np.isclose(level[k].step_rate, (np.abs(ratio - np.rint(ratio)) <= 2e-3 + 1e-5 * np.abs(np.rint(ratio))).mean())
        f, r = x[np.isfinite(x)], stats[k]
        assert np.allclose([r.samples, r.finite_rate, r.zero_rate, r.mean, r.std, r.least, r.most], [len(x), len(f) / len(x), (x == 0).mean(), f.mean(), f.std(), f.min(), f.max()])
        assert np.array_equal([r.first, r["last"]], x[[0, -1]], equal_nan=True)


def test_profile_of_records_is_stable(spark):
    rng = np.random.default_rng(8)
    signals = [1e9 + rng.normal(size=500), 1e9 + rng.normal(size=77), np.array([np.inf, -np.inf, np.nan]), rng.normal(size=33)]
    got = {r.record: r for r in chunks.profile(table(spark, signals, 10), KEYS, ["record"]).collect()}
    for record in (0, 1):
        whole = np.concatenate(signals[record::2])
        f = whole[np.isfinite(whole)]
        assert got[record].channels == 2 and np.isclose(got[record].finite_rate, len(f) / len(whole)) and np.isclose(got[record]["mean"], f.mean(), rtol=1e-14) and np.isclose(got[record]["std"], f.std(), rtol=1e-9)


def test_auxiliary_metrics(spark, signals):
    got = {r.channel: r for r in chunks.auxiliary_metrics(table(spark, signals, 13), KEYS).collect()}
    assert (got[6].levels, got[6].step_rate) == (5, 1.0) and got[2].median_run == 40 and set(got[0].asDict()) == {*KEYS, "levels", "step_rate", "least", "most", "std", "median_run", "transition_rate"}


@pytest.mark.parametrize("size", (10, 16, 91, 1000))
def test_notches(spark, size):
    rng = np.random.default_rng(6)
    hum = np.sin(np.arange(3005) * 2 * np.pi * 50 / 400)
    signals = [rng.normal(size=3005) + 5 * hum, rng.normal(size=91) + 3, np.arange(10.0), rng.normal(size=9), np.array([2.0]), np.array([*rng.normal(size=40), np.nan]), rng.normal(size=20), rng.normal(size=23).cumsum(), None]
    got = {}
    for r in chunks.notched(table(spark, signals, size), KEYS, size, 400.0).orderBy("channel", "chunk").collect():
        assert r.start == r.chunk * size == len(got.setdefault(r.channel, [])) and 1 <= len(r.samples) <= size
        got[r.channel] += r.samples
    assert set(got) == set(range(8))
    for k, x in enumerate(signals[:8]):
        want = x if len(x) < 10 else spectra.notched(x, 400.0)
        np.testing.assert_allclose(got[k], want, rtol=1e-9, atol=1e-9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # channels that begin and end anywhere in a batch
    try:
        again = chunks.notched(table(spark, signals, size), KEYS, size, 400.0).orderBy("channel", "chunk").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in got:
        np.testing.assert_allclose([v for r in again if r.channel == k for v in r.samples], got[k], rtol=1e-9, atol=1e-9)
    assert np.abs(np.array(got[0])[1000:2000] @ hum[1000:2000]) < 0.05 * np.abs(signals[0][1000:2000] @ hum[1000:2000])


def test_notches_of_null_keys_and_bad_sizes(spark):
    x = np.random.default_rng(1).normal(size=50)
    rows = chunks.cut(spark.createDataFrame([(None, 1, x.tolist()), (1, None, x[::-1].tolist())], "record int, channel int, samples array<double>"), 16)
    got = {r.record: r.x for r in chunks.notched(rows, KEYS, 16, 400.0).groupBy("record").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "samples"))), lambda s: s["samples"])).alias("x")).collect()}
    np.testing.assert_allclose(got[None], spectra.notched(x, 400.0), atol=1e-9)
    np.testing.assert_allclose(got[1], spectra.notched(x[::-1], 400.0), atol=1e-9)
    for size, rate in ((9, 400.0), (16, 300.0)):
        with pytest.raises(ValueError, match="samples|rate"):
            chunks.notched(rows, KEYS, size, rate)


def test_empty_table(spark, signals):
    none = table(spark, signals, 8).where("false")
    for found in (chunks.windows(none, KEYS, 8, 4, 2), chunks.auxiliary_metrics(none, KEYS), chunks.density(none, KEYS, 8, 100.0, 16, 8), chunks.notched(table(spark, signals, 16).where("false"), KEYS, 16, 400.0)):
        assert found.count() == 0
