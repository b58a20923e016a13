"""The given parquet tables in the shape of meter readings and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.once import with_columns_once
from gridtide.schemas import TIMESTAMP_FORMAT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as a timestamp of the session's zone."""
    return as_readings(table(spark, sf_dir, "events"))


def as_readings(events_table: DataFrame) -> DataFrame:
    """``id, ts, consumption, event_id, event_type``; batch or streaming."""
    return events_table.select(
        F.col("user_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("consumption"),
        "event_id",
        "event_type",
    )


def exact(readings: DataFrame) -> DataFrame:
    """Readings as decimals, which they are to the cent: their sums have no rounding.

    A reading that is not to the cent fails the job instead of being rounded.
    """
    given = F.col("consumption")
    cents = given.cast("decimal(18,2)")
    same = cents.cast("double").eqNullSafe(given)
    checked = F.when(same, cents).otherwise(
        F.raise_error(F.concat(F.lit("not to the cent: "), given.cast("string")))
    )
    return readings.withColumn("consumption", checked)


def as_lines(readings: DataFrame) -> DataFrame:
    """The readings as ``id,timestamp,consumption`` text, with their order columns."""
    text = F.concat_ws(",", "id", F.date_format("ts", TIMESTAMP_FORMAT), "consumption")
    return readings.select(text.alias("value"), "ts", "event_id")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up hourly temperature for most hours that have readings.

    About one hour in eleven has no row, so the missing-weather rule is used.
    """
    ts = F.col("ts").cast("timestamp")
    hours = table(spark, sf_dir, "events").select(F.date_trunc("hour", ts).alias("h")).distinct()
    # Per hour, not per event: a plain filter would be pushed below the distinct.
    parts = with_columns_once(hours, {"day": F.dayofyear("h"), "hour": F.hour("h")})
    day, hour = F.col("day"), F.col("hour")
    return parts.where((day * 24 + hour) % 11 != 0).select(
        F.unix_timestamp("h").alias("timestamp"),
        (F.lit(20) + (day * 7 + hour * 3) % 80).cast("double").alias("temperature"),
    )
