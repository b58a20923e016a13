"""CSV and line scans, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.schemas import TIMESTAMP_FORMAT

# The order of lines in a dataset: file, part of the file, line within the part.
LINE_ORDER = ["file", "block_start", "line_no"]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Header-less CSV with columns named by position.

    A declared schema costs one pass; without it types are inferred, which
    reads the data a second time.
    """
    reader = spark.read.option("timestampFormat", TIMESTAMP_FORMAT)
    if schema is not None:
        return reader.schema(schema).csv(path)
    inferred = reader.option("inferSchema", "true").csv(path)
    return inferred.toDF(*names) if names else inferred


def read_lines(spark: SparkSession, path: str | list[str], nested: bool = False) -> DataFrame:
    """``value`` and the line's place: ``file, block_start, line_no``.

    ``path`` is a file or a directory, or several; files directly below are
    read, with ``nested`` also those in folders below.
    """
    reader = spark.read.option("recursiveFileLookup", "true") if nested else spark.read
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of the files that appear in a directory, as a stream."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select("value")


def stream_csv(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Header-less CSV files as a stream; register it as a view to query it in SQL."""
    reader = spark.readStream.schema(schema).option("timestampFormat", TIMESTAMP_FORMAT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)
