"""The three row texts in which an anomaly is published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the date text of a message row.
MESSAGE_DATE_FORMAT = "EEE MMM dd HH:mm:ss zzz yyyy"


def bracket_row(id_: Column, ts_text: Column, consumption: Column, expected: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", id_, ts_text, consumption, expected), F.lit("]"))


def tuple_row(key: Column, id_: Column, ts_text: Column, consumption: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", key, id_, ts_text, consumption), F.lit(")"))


def message_row(
    key: Column, id_: Column, ts: Column, consumption: Column, expected: Column
) -> Column:
    return F.format_string(
        "%s, consumption=Consumption{id=%s, measurementTimestamp=%s, consumption=%s} expected=%s",
        key,
        id_.cast("string"),
        F.date_format(ts, MESSAGE_DATE_FORMAT),
        consumption.cast("string"),
        expected.cast("string"),
    )
