"""The linear baseline against plain NumPy on small recordings made here."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wavequarry.operators import baseline, evaluation, predictions, runs
from wavequarry.plans import evaluation as evaluation_plans

RATE, SECONDS = 400.0, 24
SCHEMA = "sample_id string, channel_index int, channel_id string, sampling_rate double, signal array<float>"


def recording(seed, onset=None, count=10):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, int(RATE * SECONDS)))
    if onset:
        t = np.arange(x.shape[1]) / RATE
        x[:4] += np.where(t >= onset, 6 * np.sin(2 * np.pi * 22 * t), 0)
    return x.astype(np.float32)


def rows(name, x, prefix="A"):
    own = [(name, k, f"POL {prefix}{k + 1}", RATE, v.tolist()) for k, v in enumerate(x)]
    return [*own, (name, len(x), "POL DC01", RATE, x[0].tolist())]  # an auxiliary input, which takes no part


@pytest.fixture(scope="module")
def cases():
    return {f"train_{k}": (recording(k, 14.0 if k % 2 else None), "AB"[k // 4 % 2], k % 2) for k in range(8)}


@pytest.fixture(scope="module")
def maps(spark, cases):
    return baseline.frame_maps(spark.createDataFrame([r for n, (x, p, _) in cases.items() for r in rows(n, x, p)], SCHEMA)).cache()


@pytest.fixture(scope="module")
def labels(spark, cases):
    return spark.createDataFrame([(n, y, p, 14.0 * y) for n, (_, p, y) in cases.items()], "record string, label int, group string, onset double")


def plain_maps(x):
    """(map, channel, frame) of a whole recording."""
    x = x.astype(float)
    x = x - np.median(x, axis=1)[:, None]
    x = np.clip(x / np.maximum(1.4826 * np.median(np.abs(x), axis=1), 1e-6)[:, None], -20, 20)
    frames = ((x[:, ::2] + x[:, 1::2]) / 2).reshape(len(x), SECONDS, 200)
    power = np.abs(np.fft.rfft(frames)) ** 2 / 200
    bands = [np.log(power[..., a:b].mean(-1) + 1e-10) for a, b in ((1, 4), (4, 8), (8, 13), (13, 30), (30, 70), (70, 95))]
    return np.stack([0.5 * np.log((frames**2).mean(-1) + 1e-8), np.log(np.abs(np.diff(frames)).mean(-1) + 1e-8), np.log(np.quantile(np.abs(frames), 0.95, axis=-1) + 1e-8), *bands])


def plain_evidence(m):
    z = []
    for v in m[[0, 1, 6, 7, 8]]:
        c = np.median(v[:, :10], axis=1)[:, None]
        z.append((v - c) / np.maximum(1.4826 * np.median(np.abs(v[:, :10] - c), axis=1), 0.15)[:, None])
    return np.maximum(np.mean(z, axis=0), 0)


def plain_track(e):
    level = np.pad(np.quantile(e, 0.9, axis=0), 1)
    return (level[:-2] + level[1:-1] + level[2:]) / 3


def plain_features(x):
    m, out = plain_maps(x), []
    for v in m:
        f = np.quantile(v, 0.9, axis=0)
        base = np.median(f[:10])
        out += [*np.quantile(v, [0.1, 0.5, 0.9, 0.99]), f.max(), f.std(), np.median(f[10:]) - base, np.quantile(f[10:], 0.9) - base]
    t = plain_track(plain_evidence(m))
    return [*out, t.max(), np.median(t[10:]), np.quantile(t[10:], 0.9), t[10:].mean()]


def plain_onset(track, threshold):
    for k in range(10, len(track) - 2):
        if min(track[k : k + 3]) >= threshold:
            return k + 0.5
    return int(np.argmax(track[10:])) + 10.5


def test_features_and_ranking(maps, cases):
    got = {r.record: r for r in baseline.record_features(maps).collect()}
    assert set(got) == set(cases) and len(baseline.FEATURES) == 76
    for name, (x, _, _) in cases.items():
        np.testing.assert_allclose([got[name][f] for f in baseline.FEATURES], plain_features(x), rtol=1e-6, atol=1e-6)
    frames = evaluation.evidence(maps, baseline.EVIDENCE)
    for r in baseline.ranked_channels(frames).collect():
        x, prefix, _ = cases[r.record]
        score = np.quantile(plain_evidence(plain_maps(x))[:, 10:], 0.9, axis=1)
        assert r.channels == [f"POL {prefix}{k + 1}" for k in np.argsort(-score, kind="stable")[:10]]


def test_onsets_and_thresholds_of_folds(maps, labels, cases):
    track = evaluation.anomaly_track(evaluation.evidence(maps, baseline.EVIDENCE))
    plain = {n: plain_track(plain_evidence(plain_maps(x))) for n, (x, _, _) in cases.items()}
    tried = [0.5, 2.0, 1e6]
    for r in baseline.onsets(track, tried).collect():
        assert r.onsets == [plain_onset(plain[r.record], t) for t in tried]
    got = {r.group: r.threshold for r in baseline.fold_thresholds(track, labels).collect()}
    for g in "AB":
        errors = [np.mean([abs(plain_onset(plain[n], t) - 14) for n, (_, p, y) in cases.items() if y and p != g]) for t in baseline.THRESHOLDS]
        assert got[g] == baseline.THRESHOLDS[int(np.argmin(np.round(errors, 9)))]
    assert all(r.threshold is None for r in baseline.fold_thresholds(track, labels.where("label = 0")).collect())


def test_model_solves_the_penalised_problem(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) * [1, 5, 0.2] + 3
    y = (x[:, 0] + rng.normal(size=40) > 3.6).astype(int)
    df = spark.createDataFrame([(f"r{k}", "AB"[k % 2], int(y[k]), *map(float, x[k])) for k in range(40)], "record string, group string, label int, a double, b double, c double")
    model = baseline.fit(df, ["a", "b", "c"])
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(40)])
    weight = np.where(y == 1, 40 / (2 * y.sum()), 40 / (2 * (40 - y.sum())))
    w, ridge = np.zeros(4), np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(0.1 * z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, 0.1 * z.T @ (weight * (p - y)) + ridge @ w)
    got = [r.probability for r in baseline.probabilities(df, model).orderBy(F.expr("int(substring(record, 2))")).collect()]
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-z @ w)), atol=1e-6)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = baseline.probabilities(df, PipelineModel.load(str(tmp_path / "model")))
    assert sorted(r.probability for r in again.collect()) == pytest.approx(sorted(got))
    folds = baseline.out_of_fold(df, ["a", "b", "c"])
    assert {(r.group, r.fold, r.n) for r in folds.groupBy("group", "fold").agg(F.count("*").alias("n")).collect()} == {("A", 1, 20), ("B", 2, 20)}
    one = baseline.probabilities(df.where("group = 'A'"), baseline.fit(df.where("group = 'B'"), ["a", "b", "c"]))
    assert sorted(r.probability for r in one.collect()) == pytest.approx(sorted(r.probability for r in folds.where("fold = 1").collect()))
    with pytest.raises(ValueError, match="both labels"):
        baseline.fit(df.where("label = 1"), ["a"])
    with pytest.raises(ValueError, match="two groups"):
        baseline.out_of_fold(df.where("group = 'A'"), ["a"])


def test_folds_fitted_together(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=(300, 3)) * [1, 50, 0.2] + [3, 1e6, 0], np.full(300, 7.0)])
    y = (x[:, 0] + 0.02 * (x[:, 1] - 1e6) + rng.normal(size=300) > 3.6).astype(int)
    group = [None if k % 10 == 9 else "hot" if k % 3 else "ABC"[k % 4 % 3] for k in range(300)]  # one group with most rows
    unknown = set(range(0, 300, 37))
    df = spark.createDataFrame([(k, group[k], None if k in unknown else int(y[k]), *map(float, x[k])) for k in range(300)], "record long, `group` string, label int, a double, b double, c double, d double").repartition(5)
    passes = []
    monkeypatch.setattr(baseline, "Summarizer", type("Counted", (), {"sum": staticmethod(lambda c, real=baseline.Summarizer.sum: passes.append(1) or real(c))}))
    got = {r.record: r for r in baseline.out_of_fold(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 300 and len(passes) <= 12  # as many as iterations, five folds at once
    order = [None, "A", "B", "C", "hot"]
    for f, g in enumerate(order):
        used = np.array([k not in unknown and group[k] != g for k in range(300)])
        v, t = x[used], y[used]
        deviation = np.where(v.std(0) > 0, v.std(0), 1)
        z = np.column_stack([(x - v.mean(0)) / deviation, np.ones(300)])
        weight = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
        w, ridge = np.zeros(5), np.diag([1.0, 1, 1, 1, 0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-z[used] @ w))
            w -= np.linalg.solve(0.1 * z[used].T @ (z[used] * (weight * p * (1 - p))[:, None]) + ridge, 0.1 * z[used].T @ (weight * (p - t)) + ridge @ w)
        for k in range(300):
            if group[k] == g:
                assert got[k].fold == f + 1 and got[k].label == (None if k in unknown else y[k]) and abs(got[k].probability - 1 / (1 + np.exp(-z[k] @ w))) < 1e-7
    with pytest.raises(ValueError, match="both labels outside group A"):
        baseline.out_of_fold(df.where("`group` in ('A', 'B')").withColumn("label", F.expr("int(`group` = 'A')")), ["a"])


def test_predictions_keep_the_contract(spark, maps, labels, cases):
    frames = evaluation.evidence(maps, baseline.EVIDENCE)
    features = baseline.record_features(maps)
    model = baseline.fit(features.join(labels, "record"))
    table = baseline.predictions(features, model, evaluation.anomaly_track(frames), baseline.ranked_channels(frames), 2.0)
    eligible = maps.select(F.col("record").alias("sample_id"), F.col("name").alias("channel_id")).distinct()
    assert predictions.violations(table, eligible, labels.select(F.col("record").alias("sample_id"))).count() == 0
    got = {r.sample_id: r for r in table.collect()}
    assert {n: r.prob >= 0.5 for n, r in got.items()} == {n: y == 1 for n, (_, _, y) in cases.items()}
    assert all(abs(r.onset_time - 14) <= 2 for r in got.values() if r.channels)


def test_runs_are_published_whole(spark, maps, labels, tmp_path, monkeypatch):
    root, frames = f"file://{tmp_path}/kept", evaluation.evidence(maps, baseline.EVIDENCE)
    features, track, ranked = baseline.record_features(maps).cache(), evaluation.anomaly_track(frames).cache(), baseline.ranked_channels(frames).cache()
    true = labels.withColumn("channels", F.when(F.col("label") == 1, F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("POL "), "group", k.cast("string")))).otherwise(F.array().cast("array<string>")))
    assert runs.latest(spark, root) is None
    with pytest.raises(ValueError, match="no run"):
        runs.predictions(features, track, ranked, root)
    columns = baseline.FEATURES[:6]
    assert runs.save(features, true, track, ranked, root, columns, "one") == 1
    kept = {r.sample_id: r for r in spark.read.parquet(f"{root}/runs/one/predictions").collect()}
    own = {r.record: r for r in baseline.out_of_fold(features.join(labels, "record"), columns).collect()}
    limit = {r.group: r.threshold for r in baseline.fold_thresholds(track, labels).collect()}
    found = {r.record: r.onsets for r in baseline.onsets(track, baseline.THRESHOLDS).collect()}
    names = {r.record: r.channels for r in ranked.collect()}
    assert set(kept) == set(own)
    for n, r in kept.items():
        assert (r.fold, r.schema_group, r.label, r.predicted_label) == (own[n].fold, own[n].group, own[n].label, int(r.prob >= 0.5)) and abs(r.prob - own[n].probability) < 1e-9
        assert r.predicted_onset == found[n][baseline.THRESHOLDS.index(limit[r.schema_group])] and [r[f"pred_ch{k}"] for k in range(1, 11)] == names[n]
    metrics = spark.read.json(f"{root}/runs/one/metrics").first()
    assert (metrics.train_samples, metrics.positive_samples, metrics.groups) == (8, 4, 2) and 0 <= metrics.score_overlap_proxy <= 1
    assert spark.read.parquet(f"{root}/runs/one/folds").count() == 2
    before = runs.predictions(features, track, ranked, root).collect()
    assert len(before) == 8
    with monkeypatch.context() as m:  # a writer that dies when all but its manifest is written
        m.setattr(runs, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.save(features, true, track, ranked, root, columns[:2], "two")
    assert runs.latest(spark, root).run == "one" and runs.predictions(features, track, ranked, root).collect() == before
    assert runs.save(features, true, track, ranked, root, columns[:2], "two") == 2 and runs.latest(spark, root).features == columns[:2]
    assert runs.save(features, true, track, ranked, root, columns, "two") == 2 and runs.manifests(spark, root).count() == 2


def test_query_of_folds(spark):
    d = "/root/testdata/sf0.001"
    got = {r.channel: r for r in evaluation_plans.out_of_fold_rise(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").collect()
    e = np.array([r.embedding for r in rows], dtype=float)
    x = np.column_stack([e[:, :48].mean(1), np.sqrt((e[:, :48] ** 2).mean(1)), np.abs(np.diff(e[:, :48])).mean(1), e[:, :48].min(1), e[:, :48].max(1), e[:, 47]])
    rms = lambda v: np.sqrt((v**2).mean(1))
    y, group = (rms(e[:, 48:]) > rms(e[:, :16])).astype(int), np.array([r.label for r in rows])
    assert len(got) == len(rows)
    for f, g in enumerate(sorted(set(group)), 1):
        v, t = x[group != g], y[group != g]
        z = np.column_stack([(x - v.mean(0)) / v.std(0), np.ones(len(x))])
        used, weight, w, ridge = z[group != g], np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum())), np.zeros(7), np.diag([1.0] * 6 + [0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-used @ w))
            w -= np.linalg.solve(0.1 * used.T @ (used * (weight * p * (1 - p))[:, None]) + ridge, 0.1 * used.T @ (weight * (p - t)) + ridge @ w)
        for k in np.flatnonzero(group == g):
            r = got[rows[k].vec_id]
            assert (r.fold, r.label) == (f, y[k]) and abs(r.probability - 1 / (1 + np.exp(-z[k] @ w))) < 2e-6


def test_records_that_do_not_suffice(spark):
    few = spark.createDataFrame(rows("train_few", recording(1, count=9)), SCHEMA)
    with pytest.raises(Exception, match="fewer than 10 contacts: train_few"):
        baseline.frame_maps(few).count()
    short = spark.createDataFrame(rows("train_short", recording(1)[:, : int(RATE * 19)]), SCHEMA)
    with pytest.raises(Exception, match="shorter than 20 seconds: train_short"):
        baseline.frame_maps(short).collect()
    assert baseline.frame_maps(few.limit(0)).count() == 0
    hashes = {r.record: r.group for r in baseline.layouts(few).collect()}
    assert len(hashes["train_few"]) == 8
