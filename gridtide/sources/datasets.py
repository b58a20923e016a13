"""The dataset catalogue: name, size and first lines of every dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.functions.text import byte_text
from gridtide.sources.files import LINE_ORDER, read_lines

PREVIEW_LINES = 5


def preview(
    lines: DataFrame, dataset: str, order: Sequence[str], lines_shown: int = PREVIEW_LINES
) -> DataFrame:
    """``dataset, preview``: the first lines of each dataset, empty ones counted but not shown.

    The rank filter runs before the shuffle too, so each task sends at most
    ``lines_shown`` lines per dataset, however long the dataset is.
    """
    place = F.row_number().over(Window.partitionBy(dataset).orderBy(*order))
    first = lines.withColumn("_place", place).where(F.col("_place") <= lines_shown)
    shown = F.when(F.length("value") > 0, F.struct("_place", "value"))
    # collect_list leaves out nulls; a dataset of empty lines keeps an empty list.
    listed = F.sort_array(F.collect_list(shown))
    return first.groupBy(dataset).agg(listed["value"].alias("preview"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files in a folder and below it, empty ones included.

    Spark lists the folder, in parallel where it is large, and reads no content.
    Its scans leave empty files out, so the names come from the listing and the
    sizes from a scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sizes = files.select(_plain("_metadata.file_path").alias("path"), "length")
    names = spark.createDataFrame([(name,) for name in files.inputFiles()], "name string")
    # The listing and the scan write the start of a path with a different number of slashes.
    path = F.regexp_replace(_plain("name"), "^file:/+", "file:///")
    listed = names.select(path.alias("path"), F.lit(0).cast("bigint").alias("length"))
    both = listed.unionByName(sizes.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")))
    return both.groupBy("path").agg(F.sum("length").alias("length"))


def _plain(path: str):
    """A path without the escapes of an address."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _dataset(path, folder: str):
    """The entry directly in ``folder`` that a path lies in; the last part of the folder names it."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return F.element_at(F.split(F.substring_index(path, f"/{name}/", -1), "/"), 1)


def catalog(spark: SparkSession, folder: str, lines_shown: int = PREVIEW_LINES) -> DataFrame:
    """``dataset_name, size, shown_size, preview`` of every dataset in a folder.

    A dataset is a file directly in the folder, or a folder in it with part
    files, whose lines count in the order of the files' names.  Names and sizes
    come from the listing.  First lines come from Spark's line scan, ranked in
    each task, so a task sends ``lines_shown`` lines per dataset at most.
    """
    sizes = (
        list_files(spark, folder)
        .groupBy(_dataset(F.col("path"), folder).alias("dataset_name"))
        .agg(F.sum("length").alias("size"))
    )
    lines = read_lines(spark, folder, nested=True)
    heads = preview(lines.withColumn("dataset_name", _dataset(_plain("file"), folder)), "dataset_name", LINE_ORDER, lines_shown)
    shown = F.coalesce("preview", F.array().cast("array<string>"))
    return sizes.join(heads, "dataset_name", "left").select(
        "dataset_name", "size", byte_text(F.col("size")).alias("shown_size"), shown.alias("preview")
    )
