"""Readings above a fixed limit or above the expected-consumption model.

Every function takes batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.keys import composite_key
from gridtide.functions.render import bracket_row, message_row, tuple_row
from gridtide.operators.model import KEY, with_hour_key
from gridtide.operators.parse import SEPARATOR, field, parse_readings

DEFAULT_LIMIT = 5


def _exceeds(consumption: Column, bound: Column) -> Column:
    # Spark ranks NaN above every number; a reading that is no number is no anomaly.
    return (consumption > bound) & ~F.isnan(consumption.cast("double"))


def above_limit(readings: DataFrame, limit: float = DEFAULT_LIMIT) -> DataFrame:
    return readings.where(_exceeds(F.col("consumption"), F.lit(limit)))


def lines_above_limit(
    lines: DataFrame, limit: float = DEFAULT_LIMIT, value: str = "value", mode: str = "permissive"
) -> DataFrame:
    """The lines, unchanged, whose third field is above the limit."""
    if mode == "strict":
        # Fails on a line without the field, and on a field that is no number.
        number = F.trim(F.element_at(F.split(value, SEPARATOR), 3)).cast("double")
    else:
        number = field(F.col(value), 2).try_cast("double")
    return lines.where(_exceeds(number, F.lit(limit)))


def rejected_limit_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines whose third field is missing or no number: ``value, reason``."""
    number = field(F.col(value), 2).try_cast("double")
    return lines.where(number.isNull()).select(
        F.col(value).alias("value"), F.lit("bad consumption").alias("reason")
    )


def with_expected(readings: DataFrame, model: DataFrame) -> DataFrame:
    """Left join on the hour key; ``expected`` is null for a reading without a model row.

    A model with several rows for a key returns the reading once per row.
    """
    return with_hour_key(readings).join(model.select(*KEY, "expected"), KEY, "left")


def above_expected(readings_with_expected: DataFrame) -> DataFrame:
    """Readings above the model; one without a model row is never an anomaly."""
    return readings_with_expected.where(_exceeds(F.col("consumption"), F.col("expected")))


def detect(readings: DataFrame, model: DataFrame) -> DataFrame:
    """``with_expected`` and ``above_expected``: Catalyst makes this one inner join."""
    return above_expected(with_expected(readings, model))


def detect_by_lookup(readings: DataFrame, model: DataFrame) -> DataFrame:
    """Map-lookup form: inner join against a model with one row per key."""
    matched = with_hour_key(readings).join(model.select(*KEY, "expected"), KEY)
    return above_expected(matched)


def render_anomalies(anomalies: DataFrame, form: str) -> DataFrame:
    """``key, value`` records of anomalies, in one of the three row texts."""
    id_, ts, consumption = F.col("id"), F.col("ts"), F.col("consumption")
    ts_text = F.col("ts_text")
    key = composite_key(id_, F.col("date"), F.col("hour"))
    if form == "bracket":
        return anomalies.select(
            F.lit(None).cast("string").alias("key"),
            bracket_row(id_, ts_text, consumption, F.col("expected")).alias("value"),
        )
    if form == "tuple":
        return anomalies.select(
            F.lit(None).cast("string").alias("key"),
            tuple_row(key, id_, ts_text, consumption).alias("value"),
        )
    if form == "message":
        return anomalies.select(
            key.alias("key"),
            message_row(key, id_, ts, consumption, F.col("expected")).alias("value"),
        )
    raise ValueError(f"unknown form: {form}")


def detect_lines(
    lines: DataFrame,
    model: DataFrame,
    form: str = "bracket",
    mode: str = "permissive",
) -> DataFrame:
    """Text lines to published anomalies: parse, match, filter, render."""
    readings = parse_readings(lines, mode=mode)
    return render_anomalies(detect(readings, model), form)
