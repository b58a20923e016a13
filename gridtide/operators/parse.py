"""Text lines to typed readings, with a reject channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.once import with_columns_once

SEPARATOR = ","
# Fixed value: how a reading's time is written.
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def field(line: Column, position: int) -> Column:
    """The trimmed field at a position, null where the line is too short."""
    return F.trim(F.get(F.split(line, SEPARATOR), F.lit(position)))


def strict_timestamp(text: Column) -> Column:
    """The time a ``yyyy-MM-dd HH:mm:ss`` text stands for, null for every other text.

    The cast alone would also take other forms; the pattern rules them out, and
    both together cost a fraction of parsing with a format.
    """
    return F.when(text.rlike(TIMESTAMP_PATTERN), text.try_cast("timestamp"))


def non_empty(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(F.length(value) > 0)


def tag_readings(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``id, ts_text, ts, consumption, reason``; ``reason`` is null for a good line.

    Dates are strict: a text that only a lenient calendar would accept
    (``2014-02-30 25:61:00``) is a reject, not another day.
    """
    line = F.col(value)
    ts_text = field(line, 1)
    fields = {
        "id": field(line, 0).try_cast("bigint"),
        "ts_text": ts_text,
        "consumption": field(line, 2).try_cast("double"),
        "ts": strict_timestamp(ts_text),
    }
    parsed = with_columns_once(lines, fields)
    reason = (
        F.when(F.col("id").isNull(), "bad id")
        .when(F.col("ts").isNull(), "bad timestamp")
        .when(F.col("consumption").isNull(), "bad consumption")
    )
    return parsed.withColumn("reason", reason)


def parse_readings(lines: DataFrame, value: str = "value", mode: str = "permissive") -> DataFrame:
    """Readings ``id, ts_text, ts, consumption`` plus the columns the lines carried.

    ``permissive`` drops bad lines (``rejected_lines`` returns them); ``strict``
    fails the job at the first one.
    """
    if mode not in ("permissive", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    tagged = tag_readings(lines, value)
    if mode == "strict":
        message = F.concat_ws(": ", F.col("reason"), F.col(value))
        # The raising expression sits in a kept column, so no pruning skips it.
        checked = F.when(F.col("reason").isNull(), F.col("id")).otherwise(
            F.raise_error(message).cast("bigint")
        )
        return tagged.withColumn("id", checked).drop("reason")
    return tagged.where(F.col("reason").isNull()).drop("reason")


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The reject channel: ``value, reason``."""
    tagged = tag_readings(lines, value)
    return tagged.where(F.col("reason").isNotNull()).select(F.col(value).alias("value"), "reason")
