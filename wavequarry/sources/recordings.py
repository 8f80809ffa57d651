"""Recording containers (NPZ, with or without a prefix before the archive) and label files.

Files are listed and read by Spark's ``binaryFile`` source, so any store that Spark reads will do; each file is decoded
in the task that holds it. What does not follow the format raises in that task: nothing is skipped silently. Listing and
metadata never decode samples, and ``channels`` decodes them only when they are asked for.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The members of a container, the label columns in order, and the signature of a plain archive.
MEMBERS = ("signal", "channel_ids", "raw_channel_indices", "sampling_rate", "valid_samples", "sample_id")
LABELS = "sample_id STRING, label TINYINT, onset_time DOUBLE, " + ", ".join(f"ch{k} STRING" for k in range(1, 11))
SIGNATURE = b"PK\x03\x04"

CONTAINERS = "path STRING, sample_id STRING, members ARRAY<STRING>, prefix_bytes BIGINT, standard_numpy_compatible BOOLEAN, file_size_bytes BIGINT"
RECORDS = "sample_id STRING, source_path STRING, sampling_rate DOUBLE, valid_samples INT, allocated_samples INT, n_channels INT, dtype STRING"
CHANNELS = "sample_id STRING, channel_index INT, raw_channel_index INT, channel_id STRING, sampling_rate DOUBLE"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npz")


def _decoded(files: DataFrame, row_of: Callable[[str, bytes, zipfile.ZipFile], list[tuple]], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    yield pd.DataFrame(row_of(path, content, archive), columns=names)

    return files.select("path", "content").mapInPandas(work, schema)


def _member(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    with archive.open(f"{name}.npy") as f:
        return np.lib.format.read_array(io.BytesIO(f.read()), allow_pickle=False)


def array_header(f: BinaryIO, name: str) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether the first index runs fastest, and type of an array; reads its header only."""
    version = np.lib.format.read_magic(f)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"{name}: array format {version} is not supported")
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def _header(archive: zipfile.ZipFile, name: str) -> tuple[tuple[int, ...], np.dtype]:
    with archive.open(f"{name}.npy") as f:
        shape, _, dtype = array_header(f, name)
    return shape, dtype


def metadata(path: str, archive: zipfile.ZipFile) -> dict:
    """Everything but the samples, checked."""
    missing = [m for m in MEMBERS if f"{m}.npy" not in archive.namelist()]
    if missing:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    shape, dtype = _header(archive, "signal")
    ids, raw = _member(archive, "channel_ids"), _member(archive, "raw_channel_indices")
    rate, valid, name = (_member(archive, m).item() for m in ("sampling_rate", "valid_samples", "sample_id"))
    if len(shape) != 2:
        raise ValueError(f"{path}: the signal has {len(shape)} dimensions, not 2")
    if ids.ndim != 1 or raw.ndim != 1 or not len(ids) == len(raw) == shape[0]:
        raise ValueError(f"{path}: channel ids {ids.shape}, raw indices {raw.shape} and signal {shape} do not fit")
    if not np.isfinite(rate) or rate <= 0:
        raise ValueError(f"{path}: sampling rate {rate}")
    if not 0 < valid <= shape[1]:
        raise ValueError(f"{path}: {valid} valid samples of {shape[1]}")
    if str(name) != _stem(path):
        raise ValueError(f"{path}: holds the record {name}")
    return {"ids": ids, "raw": raw, "rate": float(rate), "valid": int(valid), "name": str(name), "shape": shape, "dtype": str(dtype)}


def containers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each container: its members, and the bytes before its archive."""

    def row(path: str, content: bytes, archive: zipfile.ZipFile) -> list[tuple]:
        parts = archive.infolist()
        return [(path, _stem(path), [p.filename.removesuffix(".npy") for p in parts], min((p.header_offset for p in parts), default=0), content[:4] == SIGNATURE, len(content))]

    return _decoded(_files(spark, path), row, CONTAINERS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, without decoding samples."""

    def row(path: str, content: bytes, archive: zipfile.ZipFile) -> list[tuple]:
        m = metadata(path, archive)
        return [(m["name"], path, m["rate"], m["valid"], m["shape"][1], m["shape"][0], m["dtype"])]

    return _decoded(_files(spark, path), row, RECORDS)


def channels(spark: SparkSession, path: str, signal: bool = True) -> DataFrame:
    """One row for each channel of each record; ``signal`` holds the valid samples."""

    def row(path: str, content: bytes, archive: zipfile.ZipFile) -> list[tuple]:
        m = metadata(path, archive)
        rows = [(m["name"], k, int(m["raw"][k]), str(m["ids"][k]), m["rate"]) for k in range(len(m["ids"]))]
        if not signal:
            return rows
        samples = _member(archive, "signal")[:, : m["valid"]].astype(np.float32)
        return [(*r, x) for r, x in zip(rows, samples, strict=True)]

    return _decoded(_files(spark, path), row, f"{CHANNELS}, signal ARRAY<FLOAT>" if signal else CHANNELS)


def _refuse(bad: DataFrame, what: str) -> None:
    some = [r[0] for r in bad.limit(5).collect()]
    if some:
        raise ValueError(f"{what}: {', '.join(map(str, some))}")


def labels(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of label files. Other headers and values that do not cast raise when read; an id in two rows raises here."""
    parts = [spark.read.schema(LABELS).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(p) for p in paths]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    _refuse(union.groupBy("sample_id").count().where("count > 1"), "ids in more than one label row")
    return union


def discover(spark: SparkSession, root: str, label_files: list[str] | None = None, complete: bool = False) -> DataFrame:
    """sample_id, split and path of every train_*.npz and test_*.npz below a folder, checked against the labels.

    Without files of either split, with an id in two files or in both splits, or with a file that no label row covers,
    raises; ``complete`` also refuses label rows without a file.
    """
    found = _files(spark, root).select("path").withColumn("name", F.regexp_extract("path", r"([^/]+)\.npz$", 1))
    found = found.withColumn("split", F.regexp_extract("name", r"^(train|test)_", 1)).where("split <> ''").select(F.expr("substring(name, length(split) + 2)").alias("sample_id"), "split", "path", "name")
    have = {r["split"] for r in found.select("split").distinct().collect()}
    if have != {"train", "test"}:
        raise ValueError(f"{root}: needs train and test files, has {sorted(have)}")
    _refuse(found.groupBy("name").count().where("count > 1"), "more than one file of a name")
    _refuse(found.groupBy("sample_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1"), "ids in both splits")
    if label_files:
        train, known = found.where("split = 'train'").select(F.col("name").alias("sample_id")), labels(spark, *label_files).select("sample_id")
        _refuse(train.join(known, "sample_id", "left_anti"), "train files without a label")
        if complete:
            _refuse(known.join(train, "sample_id", "left_anti"), "label rows without a file")
    return found.select(F.col("name").alias("sample_id"), "split", "path").orderBy("split", "sample_id")
