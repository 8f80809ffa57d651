"""Result tables as CSV in and out, Markdown reports of bounded summaries, the export manifest and the stage-0 run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.functions import naming
from wavequarry.operators import predictions, spectra
from wavequarry.sources import recordings

#: Columns of the two intermediate tables that later analyses read.
CHANNEL_METRICS = "sample_id string, channel_id string, line50 double"
SENSITIVITY = "network_window_seconds double, channel_policy string, feature string, records long, median_abs_timing_error_seconds double, positive_contrast_rate double"
#: Rows of a table in a report, at most.
REPORT_ROWS = 1000


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, in place of what was there; columns must be plain values."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """Named columns of CSV files with headers; others are left out, and values that do not cast raise when read.

    A path that does not exist gives no rows where the table is optional and raises otherwise; so do columns that lack.
    """
    wanted = spark.createDataFrame([], schema)
    try:
        text = spark.read.option("header", True).csv(path)
    except AnalysisException as missing:
        if optional and missing.getCondition() == "PATH_NOT_FOUND":
            return wanted
        raise
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.schema.fields])


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    """A pipe table of all rows in their order; a summary of more than REPORT_ROWS rows raises instead of being cut."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: summarise before reporting")

    def cell(value: object) -> str:
        if value is None:
            return ""
        return f"{value:.{digits}f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")

    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    lines = [df.columns, ["---:" if kind in numeric else "---" for _, kind in df.dtypes], *[[cell(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def markdown_report(title: str, sections: Iterable[tuple[str, str | DataFrame]]) -> str:
    """A title, then a heading for each section over its text or its table."""
    parts = [f"# {title}"]
    for heading, body in sections:
        parts += [f"## {heading}", markdown_table(body) if isinstance(body, DataFrame) else body]
    return "\n\n".join(parts) + "\n"


def export_manifest(channels: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """A row a record for an exporter: where its set goes, its size and rate, its channels by kind, and its label and onset.

    channels(sample_id, channel_index, channel_id, sampling_rate) without samples; records without a label row have nulls.
    """
    kind = naming.role(F.col("channel_id"))
    n = lambda c: F.sum(c.cast("long"))
    each = channels.groupBy("sample_id").agg(
        F.count("*").alias("channels"), n(kind == "seeg_candidate").alias("seeg_channels"), n(kind == "auxiliary_dc").alias("auxiliary_channels"), n(kind == "unknown").alias("unknown_channels"),
        F.first("sampling_rate").alias("sampling_rate"), naming.schema_hash(_ordered()).alias("layout"),
    )
    return each.join(labels.select("sample_id", "label", "onset_time"), "sample_id", "left").select(
        "sample_id", F.concat(F.lit(folder.rstrip("/") + "/"), "sample_id", F.lit(".set")).alias("set_path"), *each.columns[1:], "label", F.when(F.col("label") == 1, F.col("onset_time")).alias("onset_time")
    )


def _ordered() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("channel_index", "channel_id"))), lambda s: s["channel_id"])


def smoke_run(spark: SparkSession, root: str, label_files: list[str], path: str, complete: bool = False) -> int:
    """Stage 0: finds and checks the data, calls every test record negative and writes the prediction file; its rows. Reads no samples."""
    found = recordings.discover(spark, root, label_files, complete)
    expected = found.where("split = 'test'").select("sample_id")
    named = spectra.eligible(recordings.channels(spark, root, signal=False)).select("sample_id", F.explode("channels").alias("channel_id"))
    return predictions.write_predictions(predictions.negative_predictions(expected), named, expected, path)
