"""Number, size, count and time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number pattern, unit names, time format.
NUMBER_PATTERN = ".##"
COUNT_UNITS = ["k", "M", "G", "T", "P", "E"]
BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB"]
ISO_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"

LONG_MIN = -(2**63)


def _whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _pattern_text(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def number_text(x: Column) -> Column:
    """At most two decimals, no leading zero: ``12.35``, ``2.0``, ``.5``."""
    return _pattern_text(x.cast("double"), NUMBER_PATTERN)


def count_text(n: Column) -> Column:
    """A count cut (not rounded) to its unit; one decimal, only below ten units."""
    n = n.cast("bigint")
    # The smallest long has no positive counterpart; its neighbour reads the same.
    size = F.abs(F.when(n == LONG_MIN, n + 1).otherwise(n))

    def scaled(power: int, unit: str) -> Column:
        tenths = _whole_div(size, F.lit(1000**power // 10))
        whole, tenth = _whole_div(tenths, F.lit(10)), tenths % 10
        with_decimal = F.concat_ws(".", whole, tenth)
        return F.concat(
            F.when((tenths < 100) & (tenth != 0), with_decimal).otherwise(whole.cast("string")),
            F.lit(unit),
        )

    cases = [(size >= 1000**p, scaled(p, u)) for p, u in enumerate(COUNT_UNITS, start=1)]
    text = size.cast("string")
    for reached, shown in cases:
        text = F.when(reached, shown).otherwise(text)
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def byte_text(n: Column) -> Column:
    """A byte count in units of 1024, at most two decimals: ``1.5 KB``."""
    n = n.cast("bigint")
    text = F.concat_ws(" ", n, F.lit(BYTE_UNITS[0]))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        # Dividing by a power of two is exact, so the rounding sees the true value.
        scaled = F.round(n / F.lit(float(1024**power)), 2)
        shown = F.concat_ws(" ", _pattern_text(scaled, "0.##"), F.lit(unit))
        text = F.when(n >= 1024**power, shown).otherwise(text)
    return F.when(n.isNotNull(), text)


def iso_time_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_TIME_FORMAT)


def duration_text(seconds: Column) -> Column:
    """Whole hours, whole minutes and whole seconds, each of the full duration."""
    s = seconds.cast("bigint")
    return F.format_string("%dh %dm %ds", _whole_div(s, F.lit(3600)), _whole_div(s, F.lit(60)), s)
