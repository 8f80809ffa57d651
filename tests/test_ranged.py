"""The ranged source: what it returns, how little it reads, and the sink's round trip."""

import io

import numpy as np
import pytest

from tests.test_recordings import container
from wavequarry.sources import ranged, recordings


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(1)
    for k, order in enumerate("CFC"):
        signal = np.asarray(rng.normal(size=(5, 1000)).astype(np.float32), order=order)
        container(tmp_path / str(k), f"train_{k}", prefix=17 * k, signal=signal, channel_ids=np.array([f"POL A{i}" for i in range(5)]), raw_channel_indices=np.arange(5, dtype=np.int32), valid_samples=np.int32(900))
    return str(tmp_path)


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def test_same_rows_as_whole_files(spark, folder):
    want = recordings.channels(spark, folder)
    for part in (1 << 26, 3000):
        got = ranged.read(spark, folder, partBytes=part)
        assert rows(got) == rows(want)
    paths = lambda df: rows(df.drop("source_path"))
    assert paths(ranged.read(spark, folder, "records")) == paths(recordings.records(spark, folder))
    assert rows(ranged.read(spark, folder, schema=recordings.CHANNELS)) == rows(recordings.channels(spark, folder, signal=False))


def test_chunks_join_to_the_signal(spark, folder):
    whole = {(r.sample_id, r.channel_index): r.signal for r in recordings.channels(spark, folder).collect()}
    parts = {}
    for r in sorted(ranged.read(spark, folder, "chunks", chunkSamples=128, partBytes=5000).collect(), key=lambda r: r.start):
        assert r.start == 128 * r.chunk
        parts.setdefault((r.sample_id, r.channel_index), []).extend(r.samples)
    assert parts == whole


def test_filters_reach_the_source(spark, folder):
    got = ranged.read(spark, folder, partBytes=3000).where("sample_id = 'train_1' and channel_index >= 3")
    assert sorted((r.sample_id, r.channel_index) for r in got.collect()) == [("train_1", 3), ("train_1", 4)]
    assert got.rdd.getNumPartitions() < ranged.read(spark, folder, partBytes=3000).rdd.getNumPartitions()
    assert ranged.read(spark, folder).where("sample_id in ('train_0', 'x') and channel_index < 2 and channel_id <> 'POL A0'").select("channel_id").collect() == [("POL A1",)]


def test_compressed_members(spark, tmp_path):
    signal = np.arange(4000, dtype=np.float32).reshape(4, 1000)
    np.savez_compressed(tmp_path / "train_9.npz", signal=signal, channel_ids=np.array(list("abcd")), raw_channel_indices=np.arange(4), sampling_rate=2.0, valid_samples=990, sample_id=np.array("train_9"))
    got = {r.channel_index: r.signal for r in ranged.read(spark, str(tmp_path), partBytes=1000).collect()}
    assert got == {k: signal[k, :990].tolist() for k in range(4)}


@pytest.mark.parametrize("order", "CF")
def test_metadata_reads_next_to_nothing(tmp_path, order):
    signal = np.asarray(np.ones((8, 200_000), np.float32), order=order)
    path = container(tmp_path, "train_1", prefix=5, signal=signal, channel_ids=np.array(list("abcdefgh")), raw_channel_indices=np.arange(8), valid_samples=np.int32(200_000))
    data = open(path, "rb").read()
    file = Counted(data)
    opened = ranged.Container(path, file)
    assert opened.meta["shape"] == (8, 200_000) and file.taken < 0.01 * len(data)
    if order == "C":
        before = file.taken
        assert sum(len(x) for _, _, x in opened.samples([3, 4], 1 << 16)) == 400_000
        assert file.taken - before < 2 * 200_000 * 4 + 5000


def test_files_beyond_two_gigabytes(spark, tmp_path):
    path = container(tmp_path, "train_1")
    data = open(path, "rb").read()
    with open(path, "wb") as f:  # a hole in front of the archive takes no room on disk
        f.seek(9 << 28)
        f.write(data)
    got = sorted(ranged.read(spark, str(tmp_path), partBytes=1 << 30).collect(), key=lambda r: r.channel_index)
    assert [r.signal for r in got] == [list(range(8)), list(range(12, 20))]


@pytest.mark.parametrize("other", [{"valid_samples": np.int32(13)}, {"sample_id": np.array("else")}, {"signal": np.zeros(3, np.float32)}])
def test_bad_containers_raise(spark, tmp_path, other):
    container(tmp_path, "train_1", **other)
    with pytest.raises(Exception, match="train_1"):
        ranged.read(spark, str(tmp_path), "records").collect()


def test_round_trip(spark, tmp_path):
    made = [("b", 1, "x", [1.0, 2.0]), ("a", 0, "POL A1", [0.5, None, 3.0]), ("b", 0, "é", [4.0, 5.0, 6.0]), ("c", 0, "y", [])]
    channels = spark.createDataFrame([r for r in made if r[3]], "sample_id string, channel_index int, channel_id string, signal array<float>")
    for _ in range(2):
        assert sorted((r.sample_id, r.n_channels) for r in ranged.write(channels, str(tmp_path / "out"), 4.0).collect()) == [("a", 1), ("b", 2)]
    got = {(r.sample_id, r.channel_index): (r.channel_id, r.sampling_rate, str(r.signal)) for r in ranged.read(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", 0): ("POL A1", 4.0, "[0.5, nan, 3.0]"), ("b", 0): ("é", 4.0, "[4.0, 5.0, 6.0]"), ("b", 1): ("x", 4.0, "[1.0, 2.0, nan]")}
    assert ranged.write(channels.where("false"), str(tmp_path / "none"), 4.0).count() == 0


def test_a_large_record_stays_whole(spark, tmp_path):
    """Settings under which Spark splits the partitions of joins."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(4000).selectExpr("if(id < 3500, 'big', concat('s', id % 5)) sample_id", "cast(id as int) channel_index", "concat('c', id) channel_id", "transform(sequence(1, 40), x -> cast(hash(id, x) as float)) signal").repartition(30)
        found = {r.sample_id: r.n_channels for r in ranged.write(rows, str(tmp_path / "w"), 1.0).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == {"big": 3500} | {f"s{k}": 100 for k in range(5)}
    assert ranged.read(spark, str(tmp_path / "w")).where("sample_id = 'big'").count() == 3500
