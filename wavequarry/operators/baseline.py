"""The linear baseline: maps of one-second frames, 76 summaries a record, a logistic model and its folds.

Samples become maps in Arrow batches, channel by channel; all that follows is grouped by record, whose channels and frames
are bounded by one recording. All folds are fitted together, on a row of summaries a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavequarry.functions import naming, robust
from wavequarry.operators import evaluation
from wavequarry.sources import shared

#: Bands in hertz (lower end included), the rate that frames are reduced to, where scaled samples are cut, and what is added before logarithms.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 70), "high": (70, 95)}
REDUCED_RATE, CUT, LITTLE, LEAST_POWER = 200.0, 20.0, 1e-8, 1e-10
MAPS = ["log_rms", "log_line", "log_abs95", *(f"log_bp_{b}" for b in BANDS)]
EVIDENCE = ["log_rms", "log_line", "log_bp_beta", "log_bp_gamma", "log_bp_high"]
SUMMARIES = ["all_q10", "all_q50", "all_q90", "all_q99", "frame_max", "frame_std", "late_minus_base", "late_q90_minus_base"]
ANOMALY = ["anomaly_max", "anomaly_median", "anomaly_q90", "anomaly_auc"]
FEATURES = [*(f"{m}_{s}" for m in MAPS for s in SUMMARIES), *ANOMALY]
#: What a record needs, the strength of the model, its decision threshold, and the thresholds tried for onsets.
LEAST_FRAMES, LEAST_CHANNELS, NAMED = 20, 10, 10
STRENGTH, DECISION = 0.1, 0.5
THRESHOLDS = [float(t) for t in np.linspace(0.5, 8.0, 31)]


def channel_maps(x: np.ndarray, rate: float) -> np.ndarray:
    """MAPS of the one-second frames (one a row) of a channel on its own robust scale."""
    second = round(rate)
    count = len(x) // second
    x = x[: count * second].astype(float)
    x -= np.median(x)
    x = np.clip(x / max(robust.MAD_FACTOR * np.median(np.abs(x)), 1e-6), -CUT, CUT)
    factor = max(1, round(rate / REDUCED_RATE))
    x = x[: len(x) // factor * factor].reshape(-1, factor).mean(axis=1)
    size = round(rate / factor)
    count = min(count, len(x) // size)
    frames = x[: count * size].reshape(count, size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / size
    frequency = np.fft.rfftfreq(size, factor / rate)
    levels = [
        np.log(np.sqrt((frames * frames).mean(axis=1) + LITTLE)),
        np.log(np.abs(np.diff(frames, axis=1)).mean(axis=1) + LITTLE),
        np.log(np.quantile(np.abs(frames), 0.95, axis=1) + LITTLE),
    ]
    for name, (low, high) in BANDS.items():
        inside = (frequency >= low) & (frequency < high)
        if not inside.any():
            raise ValueError(f"no frequency of band {name} at {rate} Hz")
        levels.append(np.log(power[:, inside].mean(axis=1) + LEAST_POWER))
    return np.column_stack(levels)


def frame_maps(channels: DataFrame) -> DataFrame:
    """record, channel (its index), name, step, MAPS of the contacts among channels (sample_id, channel_index, channel_id, sampling_rate, signal).

    A record with fewer than ten contacts, or a contact shorter than twenty seconds, is an error that names the record.
    """
    contacts = channels.where(naming.role(F.col("channel_id")) == "seeg_candidate")
    few = contacts.groupBy("sample_id").count().where(F.col("count") < LEAST_CHANNELS)
    few = few.select("sample_id", F.raise_error(F.concat(F.lit(f"fewer than {LEAST_CHANNELS} contacts: "), "sample_id")).cast("string").alias("error"))
    checked = contacts.join(few, "sample_id", "left").where("error is null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.slice(k, 1)
                x, rate = own.column("signal")[0].values, own.column("sampling_rate")[0].as_py()
                x = np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False)
                if len(x) < LEAST_FRAMES * round(rate):
                    raise ValueError(f"shorter than {LEAST_FRAMES} seconds: {own.column('sample_id')[0]}")
                found = channel_maps(x, rate)
                names = [pa.concat_arrays([own.column(c)] * len(found)) for c in ("sample_id", "channel_index", "channel_id")]
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.arange(len(found), dtype=np.int32)), *[pa.array(c) for c in found.T]], names=["record", "channel", "name", "step", *MAPS])

    schema = f"record string, channel int, name string, step int, {', '.join(f'{m} double' for m in MAPS)}"
    return checked.select("sample_id", F.col("channel_index").cast("int").alias("channel_index"), "channel_id", F.col("sampling_rate").cast("double").alias("sampling_rate"), "signal").mapInArrow(work, schema)


def record_features(maps: DataFrame) -> DataFrame:
    """record and FEATURES: quantiles over all frames of all channels, of each step's 0.9 quantile before and after the tenth, and of the evidence."""
    overall = maps.groupBy("record").agg(*[F.percentile(m, F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.99)))).alias(m) for m in MAPS])
    overall = overall.select("record", *[F.col(m)[i].alias(f"{m}_{s}") for m in MAPS for i, s in enumerate(SUMMARIES[:4])])
    steps = maps.groupBy("record", "step").agg(*[F.percentile(m, 0.9).alias(m) for m in MAPS])
    base = F.col("step") < evaluation.BASELINE_FRAMES
    tracked = []
    for m in MAPS:
        before, after = F.median(F.when(base, F.col(m))), F.when(~base, F.col(m))
        values = (F.max(m), F.stddev_pop(m), F.median(after) - before, F.percentile(after, 0.9) - before)
        tracked += [c.alias(f"{m}_{s}") for c, s in zip(values, SUMMARIES[4:], strict=True)]
    anomaly = evaluation.anomaly_summaries(evaluation.evidence(maps, EVIDENCE))
    return overall.join(steps.groupBy("record").agg(*tracked), "record").join(anomaly, "record").select("record", *FEATURES)


def ranked_channels(frames: DataFrame) -> DataFrame:
    """record, channels: names of the ten channels of the highest scores, by index where scores are equal."""
    score = frames.where(F.col("step") >= evaluation.BASELINE_FRAMES).groupBy("record", "channel", "name").agg(F.percentile("evidence", 0.9).alias("score"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "channel", "name")))
    return score.groupBy("record").agg(F.transform(F.slice(listed, 1, NAMED), lambda s: s["name"]).alias("channels"))


def onsets(track: DataFrame, thresholds: list[float]) -> DataFrame:
    """record, onsets: for each threshold the middle of the first of three steps in a row that reach it after the baseline, or of the highest step."""
    order = W.partitionBy("record").orderBy("step")
    lasting = F.when(F.lead("level", 2).over(order).isNotNull(), F.least("level", F.lead("level").over(order), F.lead("level", 2).over(order)))
    later = track.withColumn("lasting", lasting).where(F.col("step") >= evaluation.BASELINE_FRAMES)
    highest = F.max_by("step", F.struct("level", -F.col("step")))
    return later.groupBy("record").agg(F.array(*[F.coalesce(F.min(F.when(F.col("lasting") >= t, F.col("step"))), highest) + 0.5 for t in thresholds]).alias("onsets"))


def fold_thresholds(track: DataFrame, labels: DataFrame) -> DataFrame:
    """group, threshold: the first threshold of the least mean error over the positive records of all other groups, for labels (record, label, group, onset).

    Errors are summed once by group and threshold; a fold's mean is the total without its own part. Null without positive records elsewhere.
    """
    found = onsets(track, THRESHOLDS).join(labels.where("label = 1"), "record").select("group", "onset", F.posexplode("onsets").alias("k", "at"))
    own = found.groupBy("group", "k").agg(F.sum(F.abs(F.col("at") - F.col("onset"))).alias("error"), F.count("*").alias("n"))
    total = own.groupBy("k").agg(F.sum("error").alias("all_error"), F.sum("n").alias("all_n"))
    groups = labels.select("group").distinct()
    tried = groups.select("group", F.posexplode(F.array(*map(F.lit, THRESHOLDS))).alias("k", "threshold"))
    rest = tried.join(F.broadcast(total), "k").join(own, ["group", "k"], "left")  # the totals are a row a threshold
    n = F.col("all_n") - F.coalesce("n", F.lit(0))
    rest = rest.where(n > 0).withColumn("mean", F.round((F.col("all_error") - F.coalesce("error", F.lit(0.0))) / n, 9))
    best = rest.groupBy("group").agg(F.min_by("threshold", F.struct("mean", "k")).alias("threshold"))
    return groups.join(best, "group", "left")


def fit(rows: DataFrame, columns: list[str] = FEATURES) -> PipelineModel:
    """Standardised features under a logistic model with both classes of equal weight and a squared penalty.

    The scaler divides by the deviation of n - 1 rows where the penalty is meant for that of n, so the penalty is lowered by (n - 1) / n.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"needs rows of both labels, has {sorted(counts, key=str)}")
    n = sum(counts.values())
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])))
    model = LogisticRegression(
        featuresCol="scaled", labelCol="label", weightCol="weight", probabilityCol="both", rawPredictionCol="raw", predictionCol="decided",
        regParam=(n - 1) / n / (STRENGTH * n), standardization=False, maxIter=2000, tol=1e-10,
    )
    stages = [VectorAssembler(inputCols=columns, outputCol="gathered"), StandardScaler(inputCol="gathered", outputCol="scaled", withMean=True, withStd=True), model]
    return Pipeline(stages=stages).fit(weighted)


def probabilities(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds the probability of label 1."""
    return model.transform(rows).withColumn("probability", vector_to_array("both")[1]).drop("gathered", "scaled", "raw", "both", "decided")


def _fold_scales(rows: DataFrame, columns: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Groups in order and, for each group's fold, the means and deviations of all rows outside it and the weight of either label there.

    Moments are taken once by group; those of a fold are merged from the other groups' own, never from differences of totals.
    """
    moments = [e for c in columns for e in (F.avg(c), F.var_pop(c))]
    found = rows.where("label is not null").groupBy("group").agg(F.count("*"), F.sum("label"), F.array(*moments)).collect()  # a row a group
    known = {r[0]: (r[1], r[2], np.array(r[3], dtype=float).reshape(-1, 2)) for r in found}
    groups = [r["group"] for r in rows.select("group").distinct().orderBy("group").collect()]
    if len(groups) < 2:
        raise ValueError("needs two groups")
    centre, scale, weight = np.zeros((len(groups), len(columns))), np.zeros((len(groups), len(columns))), np.zeros((len(groups), 2))
    for f, g in enumerate(groups):
        others = [v for k, v in known.items() if k != g]
        n, positive = sum(v[0] for v in others), sum(v[1] for v in others)
        if not 0 < positive < n:
            raise ValueError(f"needs rows of both labels outside group {g}, has {positive} of {n}")
        centre[f] = sum(v[0] * v[2][:, 0] for v in others) / n
        deviation = np.sqrt(sum(v[0] * (v[2][:, 1] + (v[2][:, 0] - centre[f]) ** 2) for v in others) / n)
        scale[f] = np.divide(1, deviation, out=np.zeros_like(deviation), where=deviation > 1e-13 * np.abs(centre[f]))  # all alike but for rounding: no part
        weight[f] = n / (2 * (n - positive)), n / (2 * positive)
    return groups, centre, scale, weight


def _features_of(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])


def fit_folds(rows: DataFrame, columns: list[str], groups: list, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, most: int = 60) -> np.ndarray:
    """Coefficients (a row a fold, the constant last) of the models of :func:`fit` that each leave one group out, by Newton's method on all folds at once.

    An iteration is one pass over the rows, whatever the number of folds: a task adds up loss, slope and curvature of every fold that is not done, and
    these small sums are added by fold in Spark. A step that does not lower the loss is halved. The driver holds one matrix of the features' square a fold.
    """
    size, folds = len(columns) + 1, len(groups)
    place = {g: k for k, g in enumerate(groups)}
    taught = rows.where("label is not null").select("group", F.col("label").cast("int").alias("label"), *columns)

    def sums(at: np.ndarray, active: list[int]) -> dict[int, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {f: np.zeros(1 + size + size * size) for f in active}
            for b in batches:
                x, y = _features_of(b, columns), b.column("label").to_numpy(zero_copy_only=False).astype(int)
                own = np.array([place[g] for g in b.column("group").to_pylist()], dtype=int)
                for f in active:
                    used = own != f
                    z = np.column_stack([(x[used] - centre[f]) * scale[f], np.ones(used.sum())])
                    m, v = z @ at[f], weight[f][y[used]]
                    p = 0.5 + 0.5 * np.tanh(m / 2)
                    total[f][0] += (v * (np.logaddexp(0, m) - y[used] * m)).sum()
                    total[f][1 : 1 + size] += z.T @ (v * (p - y[used]))
                    total[f][1 + size :] += (z.T @ (z * (v * p * (1 - p))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(active, pa.int32()), pa.array([total[f].tolist() for f in active], pa.list_(pa.float64()))], names=["fold", "sums"])

        parts = taught.mapInArrow(work, "fold int, sums array<double>").select("fold", array_to_vector("sums").alias("sums"))
        return {r["fold"]: r["sums"].toArray() for r in parts.groupBy("fold").agg(Summarizer.sum(F.col("sums")).alias("sums")).collect()}

    ridge = np.append(np.ones(size - 1), 0.0)  # the constant bears no penalty
    base, step, share, best = np.zeros((folds, size)), np.zeros((folds, size)), np.ones(folds), np.full(folds, np.inf)
    active = list(range(folds))
    for _ in range(most):
        tried = base - share[:, None] * step
        found = sums(tried, active)
        left = []
        for f in active:
            total, w = found[f], tried[f]
            loss = STRENGTH * total[0] + 0.5 * (ridge * w * w).sum()
            if loss > best[f] + 1e-10 * max(1.0, abs(best[f])):
                share[f] /= 2
                left.append(f)
                continue
            base[f], best[f], share[f] = w, loss, 1.0
            step[f] = np.linalg.solve(STRENGTH * total[1 + size :].reshape(size, size) + np.diag(ridge), STRENGTH * total[1 : 1 + size] + ridge * w)
            if np.abs(step[f]).max() > 1e-8:
                left.append(f)
        active = left
        if not active:
            return base
    raise RuntimeError(f"folds without a solution after {most} passes: {[groups[f] for f in active]}")


def out_of_fold(rows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """record, group, fold, label, probability: each group (a channel layout) scored by a model of all others, folds numbered in the groups' order.

    All folds are fitted together, from rows that are stored once in the shared folder. Rows without a label are scored and teach nothing;
    null is a group of its own, the first. Fewer than two groups, or a fold whose other groups lack a label, are an error.
    """
    rows = shared.stored(rows.select("record", "group", "label", *columns), shared.folder(rows.sparkSession), "fold_rows")
    groups, centre, scale, weight = _fold_scales(rows, columns)
    model = fit_folds(rows, columns, groups, centre, scale, weight)
    place = {g: k for k, g in enumerate(groups)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([place[g] for g in b.column("group").to_pylist()], dtype=int)
            m = ((_features_of(b, columns) - centre[own]) * scale[own] * model[own, :-1]).sum(axis=1) + model[own, -1]
            yield pa.RecordBatch.from_arrays([b.column("record"), b.column("group"), pa.array(own + 1, pa.int32()), b.column("label"), pa.array(0.5 + 0.5 * np.tanh(m / 2))], names=["record", "group", "fold", "label", "probability"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(work, f"record {kinds['record']}, `group` {kinds['group']}, fold int, label {kinds['label']}, probability double")


def layouts(channels: DataFrame) -> DataFrame:
    """record, group: a short hash of all channel ids of a record in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("channel_index", "channel_id"))), lambda s: s["channel_id"])
    return channels.groupBy(F.col("sample_id").alias("record")).agg(naming.schema_hash(ids).alias("group"))


def predictions(rows: DataFrame, model: PipelineModel, track: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """The prediction table (sample_id, prob, decision_threshold, onset_time, channels): onset 0 and no channels below the decision threshold."""
    scored = probabilities(rows, model).select("record", "probability").join(onsets(track, [threshold]), "record").join(ranked, "record")
    positive: Column = F.col("probability") >= DECISION
    return scored.select(
        F.col("record").alias("sample_id"), F.round("probability", 6).alias("prob"), F.lit(DECISION).alias("decision_threshold"),
        F.when(positive, F.round(F.col("onsets")[0], 6)).otherwise(0.0).alias("onset_time"), F.when(positive, F.col("channels")).otherwise(F.array().cast("array<string>")).alias("channels"),
    )
