"""Outside temperature and its effect on a reading."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Temperature bands in Celsius and their factors.
OVERHEATING_BELOW, OVERHEATING_FACTOR = 5, Decimal("0.6")
HEATING_BELOW, HEATING_FACTOR = 16, Decimal("0.8")
COOLING_ABOVE, COOLING_FACTOR = 24, Decimal("0.6")
NEUTRAL_FACTOR = Decimal("1.0")
OFFSET = 7


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def _factor(value: Decimal, exact: bool) -> Column:
    return F.lit(value if exact else float(value))


def neutral_factor(exact: bool = False) -> Column:
    return _factor(NEUTRAL_FACTOR, exact)


def band_factor(temperature: Column, exact: bool = False) -> Column:
    """Factor for a Celsius temperature, null for a null one.

    NaN is in no band and neutral: all comparisons with it are false.  ``exact`` gives decimals, for readings that are decimals themselves.
    """
    return (
        # Spark ranks NaN above every number, so it is taken out first.
        F.when(F.isnan(temperature), neutral_factor(exact))
        .when(temperature < OVERHEATING_BELOW, _factor(OVERHEATING_FACTOR, exact))
        .when(temperature < HEATING_BELOW, _factor(HEATING_FACTOR, exact))
        .when(temperature > COOLING_ABOVE, _factor(COOLING_FACTOR, exact))
        .when(temperature.isNotNull(), neutral_factor(exact))
    )


def adjusted(consumption: Column, factor: Column, offset: int = OFFSET) -> Column:
    return consumption * factor + F.lit(offset)
