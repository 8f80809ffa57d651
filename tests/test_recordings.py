"""Containers, labels, the prediction contract and streams, on small files made here."""

import numpy as np
import pytest

from wavequarry.operators import predictions as P
from wavequarry.sources import recordings as R
from wavequarry.streaming import hops


def container(folder, name, prefix=0, **other):
    members = {
        "signal": np.arange(24, dtype=np.float32).reshape(2, 12), "channel_ids": np.array(["POL A1", "POL A2"]), "raw_channel_indices": np.array([4, 7], np.int32),
        "sampling_rate": np.float64(4), "valid_samples": np.int32(8), "sample_id": np.array(name),
    } | other
    folder.mkdir(parents=True, exist_ok=True)
    np.savez(folder / f"{name}.npz", **members)
    path = folder / f"{name}.npz"
    path.write_bytes(bytes(prefix) + path.read_bytes())
    return str(path)


def test_plain_and_prefixed_containers(spark, tmp_path):
    container(tmp_path, "train_1")
    container(tmp_path / "deep", "train_2", prefix=64)
    rows = {r.sample_id: r for r in R.containers(spark, str(tmp_path)).collect()}
    assert [(rows[k].prefix_bytes, rows[k].standard_numpy_compatible) for k in ("train_1", "train_2")] == [(0, True), (64, False)]
    assert set(rows["train_1"].members) == set(R.MEMBERS)
    assert {(r.sample_id, r.n_channels, r.valid_samples, r.allocated_samples, r.dtype) for r in R.records(spark, str(tmp_path)).collect()} == {("train_1", 2, 8, 12, "float32"), ("train_2", 2, 8, 12, "float32")}
    got = {(r.sample_id, r.channel_index): r for r in R.channels(spark, str(tmp_path)).collect()}
    assert got["train_2", 1].signal == list(range(12, 20)) and got["train_2", 1].channel_id == "POL A2" and got["train_2", 1].raw_channel_index == 7
    assert "signal" not in R.channels(spark, str(tmp_path), signal=False).columns and R.channels(spark, str(tmp_path), signal=False).count() == 4


@pytest.mark.parametrize(
    "other",
    [{"sampling_rate": np.float64("nan")}, {"valid_samples": np.int32(13)}, {"sample_id": np.array("else")}, {"raw_channel_indices": np.array([1], np.int32)}, {"signal": np.zeros(3, np.float32)}],
)
def test_bad_containers_raise(spark, tmp_path, other):
    container(tmp_path, "train_1", **other)
    with pytest.raises(Exception, match="train_1"):
        R.records(spark, str(tmp_path)).collect()


def label_file(path, *ids, header=None):
    names = header or "sample_id,label,onset_time," + ",".join(f"ch{k}" for k in range(1, 11))
    path.write_text("﻿" + names + "\n" + "".join(f"{i},0,0,,,,,,,,,,\n" for i in ids), encoding="utf-8")
    return str(path)


def test_labels_and_discovery(spark, tmp_path):
    for name in ("train_1", "train_2", "test_9"):
        container(tmp_path / "d", name)
    both = label_file(tmp_path / "a.csv", "train_1", "train_2", "train_3")
    assert [r.sample_id for r in R.labels(spark, both).orderBy("sample_id").collect()] == ["train_1", "train_2", "train_3"]
    found = R.discover(spark, str(tmp_path / "d"), [both])
    assert [(r.sample_id, r.split) for r in found.collect()] == [("test_9", "test"), ("train_1", "train"), ("train_2", "train")]
    for call in (
        lambda: R.discover(spark, str(tmp_path / "d"), [both], complete=True),
        lambda: R.discover(spark, str(tmp_path / "d"), [label_file(tmp_path / "b.csv", "train_1")]),
        lambda: R.labels(spark, both, both),
    ):
        with pytest.raises(ValueError, match="train_"):
            call()
    with pytest.raises(Exception, match="(?i)header|schema"):
        R.labels(spark, label_file(tmp_path / "c.csv", "x", header="sample_id,onset_time,label," + ",".join(f"ch{k}" for k in range(1, 11)))).collect()


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "sample_id string, prob double, decision_threshold double, onset_time double, channels array<string>")


def test_contract_and_file(spark, tmp_path):
    ten = [f"A{k}" for k in range(10)]
    eligible = spark.createDataFrame([(s, c) for s in ("a", "b") for c in ten], "sample_id string, channel_id string")
    expected = eligible.select("sample_id").distinct()
    good = frame(spark, ("b", 0.9, 0.5, 12.25, ten), ("a", 5e-7, 0.5, 0.0, []))
    assert P.violations(good, eligible, expected).isEmpty()
    bad = frame(spark, ("a", 0.9, 0.5, 60.0, [*ten[:9], "DC01"]), ("a", None, 0.6, 1.0, ["A1"]), ("c", float("nan"), 0.5, 1.0, None))
    got = {(r.sample_id, r.violation) for r in P.violations(bad, eligible, expected).collect()}
    assert {("a", "duplicate id"), ("a", "onset"), ("a", "ineligible channel"), ("a", "probability"), ("a", "several thresholds"), ("b", "missing id"), ("c", "unexpected id"), ("c", "probability")} <= got
    path = tmp_path / "out.csv"
    assert P.write_predictions(good, eligible, expected, str(path)) == 2
    assert path.read_text().splitlines()[1:] == ["a,0.000000,0.500000,0.000000" + "," * 10, "b,0.900000,0.500000,12.250000," + ",".join(ten)]
    edge = frame(spark, ("a", 0.4999996, 0.5, 0.0, []), ("b", 0.1, 0.5, 0.0, []))
    with pytest.raises(ValueError, match="channel count"):
        P.write_predictions(edge, eligible, expected, str(tmp_path / "edge.csv"))
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    assert P.violations(P.negative_predictions(expected), eligible, expected).isEmpty()


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    query = hops.hopping_summary(stream).writeStream.format("memory").queryName("hops").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {(r.event_type, r.start): r.n for r in spark.table("hops").collect()}
    assert got and got == {(r.event_type, r.start): r.n for r in hops.hopping_summary(events).collect()}
    assert hops.sessions(events).count() > 0
