"""Correlations of all channel pairs of a record, formed in pairs of bounded channel blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Channels of a record in one block, about.
BLOCK = 512


def _columns(samples: list[list[float | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples less their channel's mean (0 where missing), which of them are there, and each channel's length."""
    length = np.array([len(s) for s in samples], np.int64)
    x = np.full((len(samples), max(length.max(initial=0), 1)), 0.0)
    there = np.zeros(x.shape)
    for k, s in enumerate(samples):
        there[k, : len(s)] = [v is not None for v in s]
        own = np.array([v for v in s if v is not None], float)
        if len(own) and own.min() != own.max():
            x[k, there[k] > 0] = own - own.mean()
    return x, there, length


def correlations(a: list[list[float | None]], b: list[list[float | None]], lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of each a with each b ``lag`` samples later from partial sums, 0 where either is constant; and which pairs share a position."""
    (x, here, n_x), (y, there, n_y) = _columns(a), _columns(b)
    width = min(x.shape[1], y.shape[1] - lag)
    met = np.minimum(n_x[:, None], n_y[None, :] - lag) >= 1
    if width < 1:
        return np.zeros(met.shape), met
    x, here, y, there = x[:, :width], here[:, :width], y[:, lag : lag + width], there[:, lag : lag + width]
    with np.errstate(all="ignore"):
        n, sum_x, sum_y, both, xx, yy = here @ there.T, x @ there.T, here @ y.T, x @ y.T, (x * x) @ there.T, here @ (y * y).T
        spread_x, spread_y = n * xx - sum_x**2, n * yy - sum_y**2
        r = (n * both - sum_x * sum_y) / np.sqrt(spread_x * spread_y)
        plain = ~np.isfinite(r) | (spread_x <= 1e-14 * n * xx) | (spread_y <= 1e-14 * n * yy)
    return np.where(plain, 0.0, r), met


def _dealt(channels: DataFrame) -> DataFrame:
    """Pairs of blocks (record, i <= j) with the channels of both; blocks are dealt by hash, so no record is gathered whole."""
    channels = channels.where("record is not null and vec_id is not null")
    counts = channels.groupBy("record").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    return (
        channels.join(counts, "record")
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("record", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .agg(F.collect_list(F.struct("part", "vec_id", "x")).alias("m"))  # 2 BLOCK channels a group, about
    )


def _block_pairs(batches: Iterator[pa.RecordBatch], lag: int) -> Iterator[tuple[object, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """record, whether both blocks are one, ids of the sources and targets, correlations and which pairs share a position."""
    for b in batches:
        for k in range(b.num_rows):
            record, i, j, m = (b.column(c)[k].as_py() for c in ("record", "i", "j", "m"))
            sides = [([c["vec_id"] for c in m if c["part"] == p], [c["x"] or [] for c in m if c["part"] == p]) for p in ((i,) if i == j else (i, j))]
            for one, two in [(sides[0], sides[0])] if i == j else [(sides[0], sides[1])] + ([(sides[1], sides[0])] if lag else []):
                if one[0] and two[0]:
                    yield record, i == j, np.array(one[0], np.int64), np.array(two[0], np.int64), *correlations(one[1], two[1], lag)


def pair_density(channels: DataFrame, least: float) -> DataFrame:
    """record, pairs and how many of them correlate above ``least``; channels have record, vec_id and samples x."""
    kind = dict(channels.dtypes)["record"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record, same, src, dst, r, met in _block_pairs(batches, 0):
            if same:
                met = met & (src[:, None] < dst[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([record], _arrow(kind)), pa.array([int(met.sum())]), pa.array([int((met & (r > least)).sum())])], names=["record", "pairs", "over"])

    blocks = _dealt(channels).mapInArrow(work, f"record {kind}, pairs long, over long")
    return blocks.groupBy("record").agg(F.sum("pairs").alias("pairs"), F.sum("over").alias("over")).where("pairs > 0")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def strongest(channels: DataFrame, lag: int, most: int) -> DataFrame:
    """record, vec_id, and the means out and into of each channel's ``most`` largest positive correlations as source and as target."""
    kind = dict(channels.dtypes)["record"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record, same, src, dst, r, met in _block_pairs(batches, lag):
            r = np.where(met & (src[:, None] != dst[None, :] if same else True), np.maximum(r, 0), -1.0)
            for out, ids, side in ((True, src, r), (False, dst, r.T)):
                top = -np.sort(-side, axis=1)[:, :most]
                rows = top >= 0
                at = np.flatnonzero(rows.any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([record] * len(at), _arrow(kind)), pa.array(ids[at]), pa.array([out] * len(at), pa.bool_()), pa.array([top[k][rows[k]].tolist() for k in at], pa.list_(pa.float64()))],
                    names=["record", "vec_id", "out", "r"],
                )

    tops = _dealt(channels).mapInArrow(work, f"record {kind}, vec_id long, out boolean, r array<double>")
    r = tops.groupBy("record", "vec_id", "out").agg(F.slice(F.sort_array(F.flatten(F.collect_list("r")), asc=False), 1, most).alias("r"))  # ``most`` values a block
    r = r.select("record", "vec_id", "out", (F.aggregate("r", F.lit(0.0), lambda s, v: s + v) / F.size("r")).alias("mean"))
    sides = r.groupBy("record", "vec_id").agg(F.max(F.when(F.col("out"), F.col("mean"))).alias("out"), F.max(F.when(~F.col("out"), F.col("mean"))).alias("into"))
    return sides.where("out is not null and into is not null")
