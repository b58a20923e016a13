"""Several targets under one batch number, and rows counted while they are written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.literals import few_rows
from gridtide.functions.text import count_text, duration_text
from gridtide.sinks.targets import Target, write_batch

COUNTS = "part string, rows long"


def write_split(
    parts: Mapping[str, tuple[DataFrame, Target]], batch_id: int, notes: str | None = None
) -> dict[str, int]:
    """Write the parts of one batch, each to its own target; the rows of each, counted on the way.

    File targets get the folder of this batch, replaced if it is there, so a
    batch that is run again leaves every target with what it gives now.  With
    ``notes`` the counts are written last, one folder for each batch: a batch
    without a note may have some of its parts only (see ``noted_batches``).
    """
    counted: dict[str, int] = {}
    spark = None
    for name, (df, target) in parts.items():
        spark = df.sparkSession
        seen = Observation()
        write_batch(df.observe(seen, F.count(F.lit(1)).alias("rows")), target, batch_id)
        counted[name] = seen.get.get("rows") or 0
    if notes is not None and spark is not None:
        few_rows(spark, sorted(counted.items()), COUNTS).write.mode("overwrite").parquet(f"{notes}/batch={batch_id}")
    return counted


def noted_batches(spark: SparkSession, notes: str) -> DataFrame:
    """``part, rows, batch`` of the batches whose parts are all there."""
    return spark.read.schema(f"{COUNTS}, batch int").parquet(notes)


def write_with_totals(
    df: DataFrame, target: Target, started: Column | None = None, finished: Column | None = None
) -> DataFrame:
    """Write a frame; one row of its totals, taken by the job that writes it.

    ``records, shown`` and, if both times are given, ``started, finished`` and
    the ``duration`` between them.  The frame is evaluated once.
    """
    timed = started is not None and finished is not None
    metrics = [F.count(F.lit(1)).alias("records")]
    if timed:
        metrics += [F.min(F.unix_millis(started)).alias("started"), F.max(F.unix_millis(finished)).alias("finished")]
    seen = Observation()
    write_batch(df.observe(seen, *metrics), target)
    found = seen.get
    row = [found.get("records") or 0, found.get("started"), found.get("finished")]
    totals = few_rows(df.sparkSession, [row], "records bigint, started bigint, finished bigint")
    totals = totals.withColumn("shown", count_text(F.col("records")))
    if not timed:
        return totals.select("records", "shown")
    seconds = F.floor((F.col("finished") - F.col("started")) / 1000)
    return totals.select(
        "records",
        "shown",
        F.timestamp_millis("started").alias("started"),
        F.timestamp_millis("finished").alias("finished"),
        duration_text(seconds).alias("duration"),
    )
