"""Reports, result tables, the stage-0 run, the noise filter and notches."""

import numpy as np
import pytest

from test_recordings import container
from wavequarry.operators import reports, spectra
from wavequarry.sources import recordings as R


def test_tables_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "POL A1", 21.5, 1), ("b", None, None, 2)], "sample_id string, channel_id string, line50 double, more int")
    reports.write_csv(df, str(tmp_path / "t"))
    back = reports.read_csv(spark, str(tmp_path / "t"), reports.CHANNEL_METRICS)
    assert sorted(back.collect(), key=str) == sorted(df.drop("more").collect(), key=str)
    assert reports.read_csv(spark, str(tmp_path / "none"), reports.CHANNEL_METRICS, optional=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        reports.read_csv(spark, str(tmp_path / "none"), reports.SENSITIVITY)


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1, 0.5), (None, None, None)], "name string, n int, share double")
    assert reports.markdown_report("T", [("One", "text"), ("Two", df)]) == "# T\n\n## One\n\ntext\n\n## Two\n\n| name | n | share |\n| --- | ---: | ---: |\n| a\\|b | 1 | 0.5000 |\n|  |  |  |\n"
    with pytest.raises(ValueError, match="more than 1000 rows"):
        reports.markdown_table(spark.range(1001))


def test_smoke_run_and_manifest(spark, tmp_path):
    for name in ("train_1", "test_8", "test_9"):
        container(tmp_path / "data", name)
    header = "sample_id,label,onset_time," + ",".join(f"ch{k}" for k in range(1, 11))
    (tmp_path / "label.csv").write_text(f"{header}\ntrain_1,1,12.5,{','.join(f'POL A{k}' for k in range(1, 11))}\n")
    out = tmp_path / "prediction.csv"
    assert reports.smoke_run(spark, str(tmp_path / "data"), [str(tmp_path / "label.csv")], str(out)) == 2
    assert [line.split(",")[:4] for line in out.read_text().splitlines()[1:]] == [[f"test_{k}", "0.000000", "0.500000", "0.000000"] for k in (8, 9)]
    rows = {r.sample_id: r for r in reports.export_manifest(R.channels(spark, str(tmp_path / "data"), signal=False), R.labels(spark, str(tmp_path / "label.csv")), "/out/").collect()}
    assert len(rows["train_1"]) == 10 and (rows["train_1"].set_path, rows["train_1"].channels, rows["train_1"].seeg_channels, rows["train_1"].onset_time) == ("/out/train_1.set", 2, 2, 12.5)
    assert rows["test_8"].label is None and rows["test_8"].layout == rows["train_1"].layout


def test_severe_noise_is_taken_out_unless_too_few_are_left(spark):
    channels = spark.createDataFrame([(r, f"POL A{k}", [1.0]) for r, n in (("a", 12), ("b", 10)) for k in range(n)], "sample_id string, channel_id string, signal array<double>")
    metrics = spark.createDataFrame([("a", "POL A3", 20.1), ("a", "POL A4", 20.0), ("b", "POL A3", 30.0), ("a", "POL A5", None)], "sample_id string, channel_id string, line50 double")
    left = spectra.without_severe_noise(channels, metrics)
    assert {(r.sample_id, r.channel_id) for r in channels.collect()} - {(r.sample_id, r.channel_id) for r in left.collect()} == {("a", "POL A3")}
    assert left.where("sample_id = 'b'").count() == 10
    flagged = metrics.selectExpr("*", "line50 > 10 AS line50_over_10", "line50 > 20 AS line50_over_20", "false AS line100_over_10")
    got = spectra.noise_summary(flagged, ["sample_id"]).collect()
    assert [(r.sample_id, r.channels, round(r.median_50hz_excess_db, 3), r.severe_rate) for r in got] == [("b", 1, 30.0, 1.0), ("a", 3, 20.05, 0.5)]


def plain_forward(b, a, x):
    s = np.linalg.solve(np.eye(2) - np.array([[-a[1], 1], [-a[2], 0]]), b[1:] - a[1:] * b[0]) * x[0]
    out = []
    for v in x:
        y = b[0] * v + s[0]
        s = np.array([b[1] * v + s[1] - a[1] * y, b[2] * v - a[2] * y])
        out.append(y)
    return np.array(out)


def test_notches(spark):
    rate = 1000.0
    b, a = spectra.notch(50.0, rate)
    x = np.random.default_rng(2).normal(size=777) + 3
    np.testing.assert_allclose(spectra.forward(b, a, x), plain_forward(b, a, x), atol=1e-9)
    at = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / rate)) / np.polyval(a, np.exp(2j * np.pi * f / rate)))
    assert at(50) < 1e-9 and at(0) == pytest.approx(1) and at(49.5) == pytest.approx(0.5**0.5, abs=0.01)
    t = np.arange(8000) / rate
    wanted = np.sin(2 * np.pi * 10 * t)
    df = spark.createDataFrame([(1, (wanted + 2 * np.sin(2 * np.pi * 50 * t)).tolist()), (2, [1.0, 2.0]), (3, None), (4, [5.0] * 20)], "k int, samples array<double>")
    got = {r.k: r.samples for r in spectra.notch_filtered(df, rate).collect()}
    assert np.abs(np.array(got[1]) - wanted)[3000:5000].max() < 0.01
    assert got[2] == [1.0, 2.0] and got[3] is None and np.allclose(got[4], 5.0)
    with pytest.raises(ValueError, match="300"):
        spectra.notch_filtered(df, 250.0)
