"""Published models: text back to typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.keys import composite_key, key_columns
from gridtide.functions.once import with_columns_once
from gridtide.operators.parse import SEPARATOR, field, non_empty
from gridtide.sources.files import LINE_ORDER, read_lines

ON_DUPLICATE = ("last", "fanout")


def _tagged(lines: DataFrame) -> DataFrame:
    """The non-empty lines with their fields and ``reason``, which is null for a good line."""
    key = F.get(F.split("value", SEPARATOR), F.lit(0))
    expected = field(F.col("value"), 1).try_cast("double")
    fields = {"key": key, "expected": expected, **key_columns(key)}
    parsed = with_columns_once(non_empty(lines), fields)
    written = composite_key(F.col("id"), F.col("date"), F.col("hour"))
    reason = F.when(F.col("expected").isNull(), "bad expected value").when(
        ~written.eqNullSafe(F.col("key")), "bad key"
    )
    return parsed.withColumn("reason", reason)


def parse_model(
    lines: DataFrame, order: Sequence[str] = LINE_ORDER, on_duplicate: str = "last"
) -> DataFrame:
    """``id, date, hour, expected`` from ``key,number`` lines.

    Empty lines are skipped, malformed ones are in ``rejected_model_lines``: every
    non-empty line is in one of the two.  Of several lines for a key the last
    in ``order`` counts (``last``), or all of them stay (``fanout``).  The key is
    kept as three typed columns, cheaper to join on than its text; a text that
    only resembles a key (``7-2014-010-9``) would match no reading and is malformed.
    """
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"unknown on_duplicate: {on_duplicate}")
    good = (
        _tagged(lines)
        .where(F.col("reason").isNull())
        .select("id", "date", "hour", "expected", *(order if on_duplicate == "last" else ()))
    )
    if on_duplicate == "fanout":
        return good
    last = F.max_by("expected", F.struct(*order)).alias("expected")
    return good.groupBy("id", "date", "hour").agg(last)


def rejected_model_lines(lines: DataFrame) -> DataFrame:
    """Lines without a number in the second field or without a key: ``value, reason``."""
    return _tagged(lines).where(F.col("reason").isNotNull()).select("value", "reason")


def load_model(
    spark: SparkSession, path: str | list[str], on_duplicate: str = "last"
) -> DataFrame:
    """The model in a file, or in all files of directories, in the order of their paths."""
    return parse_model(read_lines(spark, path), LINE_ORDER, on_duplicate)
