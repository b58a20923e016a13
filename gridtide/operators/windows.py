"""Event-time windows and joins, for batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.operators.order import with_max_before


def tumbling(
    df: DataFrame, size: str, keys: Sequence[str], aggregates: Sequence[Column], ts: str = "ts"
) -> DataFrame:
    """Aggregates per key and window; adds ``window_start, window_end``."""
    return sliding(df, size, None, keys, aggregates, ts)


def sliding(
    df: DataFrame,
    size: str,
    slide: str | None,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    ts: str = "ts",
) -> DataFrame:
    """Aggregates per key over windows that start every ``slide``."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = df.groupBy(window.alias("_window"), *keys).agg(*aggregates)
    return grouped.select(
        *keys,
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *[c for c in grouped.columns if c not in {"_window", *keys}],
    )


def sliding_totals(
    df: DataFrame,
    size: str,
    slide: str,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    count: str = "n",
    ts: str = "ts",
) -> DataFrame:
    """Counts and sums of ``sliding`` windows whose size is a multiple of their slide.

    Readings are summed per slide first, and only these sums are spread over the
    windows they belong to; ``sliding`` spreads every reading.
    """
    parts = {name: F.sum(column).alias(name) for name, column in sums.items()}
    per_slide = df.groupBy(F.window(ts, slide).alias("_slide"), *keys).agg(
        F.count(F.lit(1)).alias(count), *parts.values()
    )
    totals = [F.sum(name).alias(name) for name in (count, *sums)]
    begun = per_slide.withColumn("_begin", F.col("_slide.start"))
    return sliding(begun, size, slide, keys, totals, "_begin")


def with_watermark(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Rows later than the delay are dropped by the stateful operators that follow."""
    return df.withWatermark(ts, delay)


def late_rows(
    df: DataFrame,
    arrival: Sequence[str],
    delay_seconds: int,
    ts: str = "ts",
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Rows that arrive after a row whose time is ahead by more than the delay."""
    seen = with_max_before(
        df, arrival, ts, rows_per_segment=rows_per_segment, total_rows=total_rows, stored=stored, into="_seen"
    )
    behind = F.col(ts) < F.col("_seen") - F.make_dt_interval(secs=F.lit(float(delay_seconds)))
    return seen.where(behind).drop("_seen")


def time_cell(ts: Column | str, width: Column) -> Column:
    """The number of the cell, ``width`` microseconds wide, that an instant lies in."""
    micros = F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
    # Whole numbers throughout: a quotient of doubles could fall into the cell beside.
    return F.call_function("div", micros - F.pmod(micros, width), width)


def cell_width(within: str) -> Column:
    """At least as many microseconds as the interval ever has.

    A sixteenth is added because months differ: so many of them counted from
    one date are never longer than that.
    """
    micros = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {within}"))
    return F.greatest(micros + F.call_function("div", micros, F.lit(16)), F.lit(1)).cast("bigint")


def join_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    within: str,
) -> DataFrame:
    """Inner join on the keys, the right time at or up to ``within`` after the left.

    Time is cut into cells as wide as the interval.  A left row stands in its
    own cell; a right row is shown to its own and to the one before, so every
    pair meets in the left row's cell, once, and key and cell are what the join
    is on.  A repeated key is then compared with what is near it in time, not
    with all its rows, and a hot one takes a task for each cell.

    For two streams both sides need a watermark; the time range then tells
    Spark when it may drop buffered rows.  Rows with a null key or time match
    nothing.
    """
    width = cell_width(within)
    right_keys = {k: f"_right_{k}" for k in [*keys, "_cell"]}
    own = time_cell(right_ts, width)
    shown = right.where(F.col(right_ts).isNotNull()).withColumn("_cell", F.explode(F.array(own, own - 1)))
    renamed = shown.withColumnsRenamed(right_keys)
    on = F.expr(f"{right_ts} >= {left_ts} AND {right_ts} <= {left_ts} + INTERVAL {within}")
    for key, other in right_keys.items():
        on = on & (F.col(key) == F.col(other))
    return left.withColumn("_cell", time_cell(left_ts, width)).join(renamed, on).drop(*right_keys.values(), "_cell")
