"""Tables that several jobs share, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name below the shared folder; a temporary folder of this machine only where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='shared-')).rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str, name: str) -> DataFrame:
    """Writes the rows and reads them back: later jobs start from the files, and a lost executor costs no more than its own tasks."""
    df.write.parquet(f"{where}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/{name}")
