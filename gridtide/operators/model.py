"""The hourly expected-consumption model.

``expected(id, date, hour)`` is the mean of the weather-adjusted readings of
that hour on the days the chosen mode looks at.  Readings are summed per
``(id, date, hour)`` before anything else happens to them: the weather factor
depends on the hour only, so it is applied to the sums, and the day shift then
multiplies grouped rows instead of readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.keys import composite_key
from gridtide.functions.text import number_text
from gridtide.functions.weather import OFFSET, adjusted, band_factor, celsius, neutral_factor

KEY = ["id", "date", "hour"]
MODES = ("literal", "minus_days", "trailing")
MISSING_WEATHER = ("neutral", "drop", "error")


def with_hour_key(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the typed key columns ``date, hour``."""
    return df.withColumns({"date": F.to_date(ts), "hour": F.hour(ts)})


def weather_hours(weather: DataFrame) -> DataFrame:
    """``date, hour, temperature`` (Fahrenheit) from a raw weather table in epoch seconds."""
    at = F.timestamp_seconds("timestamp")
    return weather.select(F.to_date(at).alias("date"), F.hour(at).alias("hour"), "temperature")


def _check_policy(policy: str) -> None:
    if policy not in MISSING_WEATHER:
        raise ValueError(f"unknown missing_weather: {policy}")


def _otherwise(policy: str, value: Column, neutral: Column) -> Column:
    """``value``; where it is null the neutral one, or an error if that is the policy."""
    if policy == "error":
        return F.coalesce(value, F.raise_error(F.lit("reading without a temperature")))
    return F.coalesce(value, neutral)


def _known(weather: DataFrame, policy: str) -> DataFrame:
    """The weather rows that count: a row without a temperature is no row under ``drop``."""
    return weather.where(F.col("temperature").isNotNull()) if policy == "drop" else weather


def join_weather(
    readings: DataFrame, weather: DataFrame, missing_weather: str = "neutral"
) -> DataFrame:
    """Readings with ``temperature, factor, adjusted``; an hour's several rows fan out.

    A missing row and a row without a temperature are the same: ``neutral``
    gives the factor 1, ``drop`` no row, ``error`` fails the job.
    """
    _check_policy(missing_weather)
    hours = _known(weather, missing_weather).select("date", "hour", "temperature")
    exact = isinstance(readings.schema["consumption"].dataType, T.DecimalType)
    how = "inner" if missing_weather == "drop" else "left"
    joined = with_hour_key(readings).join(hours, ["date", "hour"], how)
    band = band_factor(celsius(F.col("temperature")), exact)
    factor = _otherwise(missing_weather, band, neutral_factor(exact))
    return joined.withColumn("factor", factor).withColumn(
        "adjusted", adjusted(F.col("consumption"), F.col("factor"))
    )


def hourly_factors(weather: DataFrame, missing_weather: str = "neutral") -> DataFrame:
    """Per hour, the sum of its weather rows' factors in tenths, and how many rows there are.

    Rows without a temperature count as ``join_weather`` counts them.
    """
    band = band_factor(celsius(F.col("temperature")), exact=True)
    factor = _otherwise(missing_weather, band, neutral_factor(exact=True))
    return (
        _known(weather, missing_weather)
        .groupBy("date", "hour")
        .agg(
            F.sum((factor * 10).cast("int")).alias("tenths"),
            F.count(F.lit(1)).alias("rows_in_hour"),
        )
    )


def hourly_partials(readings: DataFrame) -> DataFrame:
    """Sum and count of the readings of each ``(id, date, hour)``; null readings are no readings."""
    return (
        with_hour_key(readings.where(F.col("consumption").isNotNull()))
        .groupBy(*KEY)
        .agg(F.sum("consumption").alias("total"), F.count(F.lit(1)).alias("n"))
    )


def reading_unit(readings: DataFrame) -> int | None:
    """Units per whole for decimal readings, which are summed as whole numbers; else None."""
    kind = readings.schema["consumption"].dataType
    return 10**kind.scale if isinstance(kind, T.DecimalType) else None


def adjusted_partials(
    readings: DataFrame, weather: DataFrame, offset: int, missing_weather: str
) -> DataFrame:
    """Partials of the adjusted readings: sum(c * f + offset) = sum(c) * f + offset * n.

    An hour with several weather rows counts each reading once per row, as the
    row-wise join would.  ``total`` is in tenths of the readings' unit.
    """
    unit = reading_unit(readings)
    if unit:
        # Sums of longs are exact and several times faster than sums of wide decimals.
        units = (F.col("consumption") * unit).cast("bigint")
        readings = readings.withColumn("consumption", units)
    _check_policy(missing_weather)
    how = "inner" if missing_weather == "drop" else "left"
    hours = hourly_factors(weather, missing_weather)
    # No broadcast hint: adaptive execution knows the size of the hours when they are there.
    joined = hourly_partials(readings).join(hours, ["date", "hour"], how)
    tenths = _otherwise(missing_weather, F.col("tenths"), F.lit(10).cast("bigint"))
    n = F.col("n") * F.coalesce("rows_in_hour", F.lit(1))
    total = F.col("total") * tenths + n * (offset * 10 * (unit or 1))
    return joined.select(*KEY, total.alias("total"), n.alias("n"))


def shift_partials(partials: DataFrame, lags: Sequence[int], mode: str) -> DataFrame:
    """Move each hour's partials to the days whose expectation they feed."""
    if mode == "literal":
        # Every lag lands on the day before, so nothing has to be merged.
        k = len(lags)
        return partials.select(
            "id",
            F.date_sub("date", 1).alias("date"),
            "hour",
            (F.col("total") * k).alias("total"),
            (F.col("n") * k).alias("n"),
        )
    sign = -1 if mode == "minus_days" else 1
    days = F.explode(F.array(*[F.lit(sign * lag) for lag in lags]))
    # Partitioned by (id, hour) before the copies are made: one copy of each row
    # crosses the network, and the grouping by (id, date, hour) finds its rows in place.
    placed = partials.repartition("id", "hour").withColumn("_days", days)
    return (
        placed.withColumn("date", F.date_add("date", F.col("_days")))
        .groupBy(*KEY)
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )


def expected_of(shifted: DataFrame, unit: int | None) -> DataFrame:
    """``id, date, hour, expected, n`` from shifted sums in tenths of the readings' unit."""
    whole = F.lit(10.0 * (unit or 1))
    expected = F.col("total").cast("double") / whole / F.col("n")
    return shifted.select(*KEY, expected.alias("expected"), "n")


def build_expected_model(
    readings: DataFrame,
    weather: DataFrame,
    lags: Sequence[int] = (1, 2, 3),
    mode: str = "trailing",
    offset: int = OFFSET,
    missing_weather: str = "neutral",
) -> DataFrame:
    """``id, date, hour, expected, n`` from readings ``id, ts, consumption``.

    ``weather`` is ``date, hour, temperature`` in Fahrenheit.  Modes:

    * ``trailing``: day D averages the days D - lag;
    * ``minus_days``: the readings of day D go to the days D - lag;
    * ``literal``: every lag means one day, so day D averages day D + 1.

    Decimal readings are summed exactly, and the model is then the same
    whatever the order of the rows; double readings are summed as doubles.
    ``offset`` is a whole number.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if not lags:
        raise ValueError("at least one lag required")
    partials = adjusted_partials(readings, weather, offset, missing_weather)
    return expected_of(shift_partials(partials, lags, mode), reading_unit(readings))


def model_lines(model: DataFrame) -> DataFrame:
    """The published text, ``value`` = ``key,number``."""
    key = composite_key(F.col("id"), F.col("date"), F.col("hour"))
    return model.select(F.concat_ws(",", key, number_text(F.col("expected"))).alias("value"))
