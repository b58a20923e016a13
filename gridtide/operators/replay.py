"""Replaying a dataset: send slots, latency markers, run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.text import count_text, duration_text, iso_time_text
from gridtide.operators.order import with_position

TIMER_TOPIC = "timer"


def send_slots(
    df: DataFrame,
    records_per_second: int,
    order: Sequence[str],
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add ``slot``, the second in which a record is due at a steady rate."""
    if records_per_second < 1:
        raise ValueError("records_per_second must be positive")
    placed = with_position(
        df, order, rows_per_segment=rows_per_segment, total_rows=total_rows, stored=stored, into="_position"
    )
    slot = F.call_function("div", F.col("_position"), F.lit(records_per_second))
    return placed.withColumn("slot", slot).drop("_position")


def send_records(df: DataFrame, value: str = "value", at: Column | None = None) -> DataFrame:
    """``key, value`` records, keyed by the send time in milliseconds."""
    at = F.current_timestamp() if at is None else at
    return df.select(F.unix_millis(at).cast("string").alias("key"), F.col(value).alias("value"))


def marker_records(
    lines: DataFrame, marker: str | Column, value: str = "value", at: Column | None = None
) -> DataFrame:
    """One timer record for each line that equals the marker."""
    at = F.current_timestamp() if at is None else at
    marker = F.lit(marker) if isinstance(marker, str) else marker
    return lines.where(F.col(value) == marker).select(
        F.lit(TIMER_TOPIC).alias("topic"),
        F.unix_millis(at).cast("string").alias("key"),
        F.concat(F.lit("GENERATED: "), iso_time_text(at)).alias("value"),
    )


def run_totals(records: DataFrame) -> DataFrame:
    """One row: how many records there are, as a number and as shown."""
    total = records.agg(F.count(F.lit(1)).alias("records"))
    return total.withColumn("shown", count_text(F.col("records")))


def timed_totals(records: DataFrame, started: Column, finished: Column) -> DataFrame:
    """``run_totals`` with the first and last send time and the time between them."""
    total = records.agg(
        F.count(F.lit(1)).alias("records"),
        F.min(started).alias("started"),
        F.max(finished).alias("finished"),
    )
    seconds = F.floor((F.unix_millis("finished") - F.unix_millis("started")) / 1000)
    return total.withColumns(
        {"shown": count_text(F.col("records")), "duration": duration_text(seconds)}
    )
