"""A data source for recording containers that reads byte ranges, and the sink that writes containers.

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").option("rows", "records" | "channels" | "chunks").load(folder)

A partition is a file and a share of its channels, planned from the listing alone. The task that reads it takes the archive's directory from
the file's end and the small members, then only the samples of its channels: those of a plain member lie at known places and are
read a channel or a chunk at a time, so a file may have any size. ``records`` never touch samples, nor do ``channels`` whose schema
leaves ``signal`` out. Filters on sample_id leave files out, those on channel_index leave channels out, before anything of them is read.
A compressed member can't be entered midway: its channels are unpacked one after another by the partition of the first share.

Files are opened with pyarrow.fs, which knows local paths, hdfs, s3 and gs; stores that only Spark reads are left to
``recordings.channels``. What breaks the format raises in the task, with the file's name.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from wavequarry.sources import recordings

#: Bytes of a file that one partition covers, about, and samples of a chunk.
PART_BYTES, CHUNK_SAMPLES = 64 << 20, 1 << 16
#: Bytes that are read at a time from a member whose channels are interleaved, or that is compressed.
BLOCK_BYTES = 4 << 20
CHUNKS = f"{recordings.CHANNELS}, chunk INT, start BIGINT, samples ARRAY<FLOAT>"
SCHEMAS = {"records": recordings.RECORDS, "channels": f"{recordings.CHANNELS}, signal ARRAY<FLOAT>", "chunks": CHUNKS}


class Container:
    """An open container; only what is asked for is read."""

    def __init__(self, path: str, file: BinaryIO):
        self.path, self.file = path, file
        self.archive = zipfile.ZipFile(file)
        self.meta = recordings.metadata(path, self.archive)

    def plain_rows(self, wanted: Sequence[int], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """channel, first sample and samples of a member stored as it is, ``size`` samples at a time."""
        info = self.archive.getinfo("signal.npy")
        self.file.seek(info.header_offset)
        head = self.file.read(30)
        at = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        self.file.seek(at)
        # an array's header is some hundred bytes
        header = io.BytesIO(self.file.read(min(info.file_size, 4096)))
        shape, interleaved, dtype = recordings.array_header(header, "signal")
        at, width, valid = at + header.tell(), dtype.itemsize, self.meta["valid"]
        if not interleaved:
            for k in wanted:
                for start in range(0, valid, size):
                    self.file.seek(at + (k * shape[1] + start) * width)
                    n = min(size, valid - start)
                    yield k, start, np.frombuffer(self.file.read(n * width), dtype, n)
            return
        # all channels of a sample stand together: one pass takes a span of time of the wanted ones
        span = max(1, BLOCK_BYTES // (shape[0] * width))
        for start in range(0, valid, size):
            n, parts = min(size, valid - start), []
            for first in range(start, start + n, span):
                several = min(span, start + n - first)
                self.file.seek(at + first * shape[0] * width)
                parts.append(np.frombuffer(self.file.read(several * shape[0] * width), dtype).reshape(several, shape[0])[:, wanted])
            block = np.concatenate(parts)
            for column, k in enumerate(wanted):
                yield k, start, block[:, column]

    def packed_rows(self, wanted: Sequence[int], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """The same of a compressed member, unpacked from its beginning."""
        with self.archive.open("signal.npy") as member:
            shape, interleaved, dtype = recordings.array_header(member, "signal")
            if interleaved:
                raise ValueError(f"{self.path}: a compressed signal must be stored channel by channel")
            valid, at = self.meta["valid"], 0
            for k in wanted:
                for start in range(0, valid, size):
                    n, to = min(size, valid - start), (k * shape[1] + start) * dtype.itemsize
                    while at < to:
                        at += len(member.read(min(BLOCK_BYTES, to - at)))
                    data = member.read(n * dtype.itemsize)
                    at += len(data)
                    yield k, start, np.frombuffer(data, dtype, n)

    def samples(self, wanted: Sequence[int], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        plain = self.archive.getinfo("signal.npy").compress_type == zipfile.ZIP_STORED
        return (self.plain_rows if plain else self.packed_rows)(wanted, size)


class Share(InputPartition):
    """A file and which share of its channels to read."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class RangedReader(DataSourceReader):
    def __init__(self, folder: str, rows: str, chunk: int, part: int, schema: StructType):
        self.folder, self.rows, self.chunk, self.part, self.schema = folder, rows, chunk, part, schema
        self.ids: set[str] | None = None
        self.low, self.high = 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sample_id",):
                ids = set(f.value) if isinstance(f, In) else {f.value}
                self.ids = ids if self.ids is None else self.ids & ids
            elif self.rows != "records" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("channel_index",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.folder)
        shares = []
        for info in store.get_file_info(fs.FileSelector(path, recursive=True)):
            if info.is_file and info.base_name.endswith(".npz") and (self.ids is None or info.base_name.removesuffix(".npz") in self.ids):
                parts = 1 if not self.with_samples() else max(1, -(-info.size // self.part))
                shares += [Share(info.path, k, parts) for k in range(parts)]
        return sorted(shares, key=lambda s: (s.path, s.part))

    def with_samples(self) -> bool:
        return any(f.name in ("signal", "samples") for f in self.schema)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as file:
            yield from self.rows_of(Container(partition.path, file), partition)

    def rows_of(self, container: Container, share: Share) -> Iterator[pa.RecordBatch]:
        m = container.meta
        if self.rows == "records":
            yield self.batch([{"sample_id": m["name"], "source_path": container.path, "sampling_rate": m["rate"], "valid_samples": m["valid"], "allocated_samples": m["shape"][1], "n_channels": m["shape"][0], "dtype": m["dtype"]}])
            return
        n, parts = m["shape"][0], share.parts
        if parts > 1 and container.archive.getinfo("signal.npy").compress_type != zipfile.ZIP_STORED:
            first, last = (0, n) if share.part == 0 else (0, 0)
        else:
            first, last = share.part * n // parts, (share.part + 1) * n // parts
        wanted = list(range(max(first, self.low), min(last, self.high)))
        row = lambda k: {"sample_id": m["name"], "channel_index": k, "raw_channel_index": int(m["raw"][k]), "channel_id": str(m["ids"][k]), "sampling_rate": m["rate"]}
        if not self.with_samples():
            if wanted:
                yield self.batch([row(k) for k in wanted])
        elif wanted:
            size = self.chunk if self.rows == "chunks" else m["valid"]
            for k, start, x in container.samples(wanted, size):
                more = {"chunk": start // size, "start": start, "samples": x} if self.rows == "chunks" else {"signal": x}
                yield self.batch([row(k) | more])

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
        columns = []
        for f in self.schema:
            kind = kinds[f.dataType.simpleString()]
            values = [r[f.name] for r in rows]
            columns.append(pa.array([v.astype(np.float32) for v in values] if kind == kinds["array<float>"] else values, kind))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema])


class Recordings(DataSource):
    """Options: rows (records, channels or chunks), chunkSamples, partBytes. A schema given by the user picks columns."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def kind(self) -> str:
        kind = self.options.get("rows", "channels")
        if kind not in SCHEMAS:
            raise ValueError(f"rows must be one of {', '.join(SCHEMAS)}, not {kind}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self.kind()]

    def reader(self, schema: StructType) -> RangedReader:
        return RangedReader(self.options["path"], self.kind(), int(self.options.get("chunksamples", CHUNK_SAMPLES)), int(self.options.get("partbytes", PART_BYTES)), schema)


def read(spark: SparkSession, folder: str, rows: str = "channels", schema: str | None = None, **options: int) -> DataFrame:
    """Rows of all containers below a folder; ``schema`` leaves columns out, ``signal`` among them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    reader = spark.read.format("recordings").option("rows", rows).options(**options)
    return (reader.schema(schema) if schema else reader).load(folder)


def _array(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, x, allow_pickle=False)
    return out.getvalue()


def write(channels: DataFrame, folder: str, rate: float) -> DataFrame:
    """Writes a container for each record of channels (sample_id, channel_index, channel_id, signal); returns sample_id, path, n_channels.

    A record's channels are sorted into one task and pass through it one at a time. Shorter channels are filled up with NaN; null samples
    become NaN. A file appears under its name only when it is whole, so a task that is run again replaces it by the same.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    channels = channels.withColumn("signal", F.coalesce("signal", F.array().cast("array<float>")))
    # the window brings a record's rows together in order and, unlike a join, is never split where a record is large
    whole = W.partitionBy("sample_id").orderBy("channel_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = channels.select("sample_id", "channel_index", "channel_id", F.col("signal").cast("array<float>").alias("signal"))
    rows = rows.withColumns({"n": F.count("*").over(whole).cast("int"), "width": F.max(F.size("signal")).over(whole)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = fs.FileSystem.from_uri(folder)
        name, archive, member = None, None, None

        def finish() -> pa.RecordBatch:
            member.close()
            for key, value in (("channel_ids", np.array(ids)), ("raw_channel_indices", np.array(raw, np.int32)), ("sampling_rate", np.float64(rate)), ("valid_samples", np.int32(width)), ("sample_id", np.array(name))):
                archive.writestr(f"{key}.npy", _array(np.asarray(value)))
            archive.close()
            stream.close()
            place.move(draft, f"{at}/{name}.npz")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{at}/{name}.npz"]), pa.array([len(ids)], pa.int32())], names=["sample_id", "path", "n_channels"])

        for b in batches:
            for k in range(b.num_rows):
                own = b.column("sample_id")[k].as_py()
                if own != name:
                    if name is not None:
                        yield finish()
                    name, ids, raw = own, [], []
                    n, width = b.column("n")[k].as_py(), b.column("width")[k].as_py()
                    draft = f"{at}/{name}.{uuid.uuid4().hex}.part"
                    stream = place.open_output_stream(draft)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    member = archive.open("signal.npy", "w", force_zip64=True)
                    np.lib.format.write_array_header_1_0(member, {"descr": "<f4", "fortran_order": False, "shape": (n, width)})
                x = b.column("signal")[k].values.to_numpy(zero_copy_only=False).astype("<f4")
                member.write(np.concatenate([x, np.full(width - len(x), np.nan, "<f4")]).tobytes())
                ids.append(b.column("channel_id")[k].as_py())
                raw.append(b.column("channel_index")[k].as_py())
        if name is not None:
            yield finish()

    return rows.mapInArrow(work, "sample_id STRING, path STRING, n_channels INT")
