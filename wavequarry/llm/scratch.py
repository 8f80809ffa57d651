"""Tables and files that several jobs of one operator share, in the folder of spark.checkpoint.dir, the size of batches, and what outlives a task in its Python worker."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see; a temporary one only where no checkpoint folder is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_by_user = spark.sparkContext.getCheckpointDir()
        root = set_by_user or f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        if not set_by_user:
            spark.sparkContext.setCheckpointDir(root)
            root = spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; nothing is left to do
        pass


#: Bytes of an Arrow batch between the JVM and a Python worker, at most; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Rows that Spark's Parquet reader decodes at a time, at most; 4,096 texts take tens of MB of the heap in each task.
READER_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's limits on Arrow batches, of which JVM and worker hold several copies each, and on the Parquet reader's."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        now = conf.get(key, None)
        if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
            conf.set(key, str(most))
    return df


_held: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What tasks of one operator keep for each other in a worker, one thing at a time; workers outlive tasks."""
    if name not in _held:
        drop_kept()
        _held[name] = make()
    return _held[name]


def drop_kept() -> None:
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system; allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def lean(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same task, which first drops what another operator's tasks have kept in its worker and at last gives back what it has freed."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch], *args: Any, **named: Any) -> Iterator[pa.RecordBatch]:
        drop_kept()
        yield from work(batches, *args, **named)
        trim()

    return run


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for name in names:
        _remove(spark, f"{folder}/{name}")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes the rows once and reads them back, which ends their lineage."""
    path = f"{folder}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
