import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtide import functions as G


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_composite_key(spark):
    df = spark.sql("SELECT 7L AS id, timestamp'2014-01-10 09:15:00' AS ts")
    key = G.composite_key(F.col("id"), F.to_date("ts"), F.hour("ts"))
    assert df.select(key).first()[0] == "7-2014-10-9"


def test_key_columns_read_back_what_was_written(spark):
    keys = ["7-2014-10-9", "-7-2016-366-0", "x-2014-10-9", "7-2014-10", "", None, "7-2014-0-9"]
    parts = G.key_columns(F.col("x"))
    got = column(spark, keys, "string", F.struct(*[parts[c] for c in ("id", "date", "hour")]))
    assert tuple(got[0]) == (7, dt.date(2014, 1, 10), 9)
    assert tuple(got[1]) == (-7, dt.date(2016, 12, 31), 0)
    assert got[2][0] is None
    assert all(None in tuple(row) for row in got[3:])


@pytest.mark.parametrize(
    ("fahrenheit", "expected"),
    [(40.0, 13.0), (41.0, 15.0), (59.0, 15.0), (68.0, 17.0), (77.0, 13.0)],
)
def test_bands(spark, fahrenheit, expected):
    factor = G.band_factor(G.celsius(F.col("x")))
    assert column(spark, [fahrenheit], "double", G.adjusted(F.lit(10.0), factor)) == [expected]


def test_band_edges_belong_to_the_milder_band(spark):
    assert column(spark, [5.0, 16.0, 24.0], "double", G.band_factor(F.col("x"))) == [0.8, 1.0, 1.0]
    assert column(spark, [None], "double", G.band_factor(F.col("x"))) == [None]


def test_number_text(spark):
    values = [2.0, 0.5, 12.345, 0.125, 0.135, 0.001, 2.675]
    shown = ["2.0", ".5", "12.35", ".12", ".14", ".0", "2.67"]
    assert column(spark, values, "double", G.number_text(F.col("x"))) == shown


def test_count_text(spark):
    values = [0, 999, 1000, 1234, 12345, 999999, 1500000, -1500, 10**18, 2**63 - 1, -(2**63), None]
    shown = ["0", "999", "1k", "1.2k", "12k", "999k", "1.5M", "-1.5k", "1E", "9.2E", "-9.2E", None]
    assert column(spark, values, "bigint", G.count_text(F.col("x"))) == shown


def test_byte_text(spark):
    values = [0, 500, 1023, 1024, 1536, 1152, 1048576, 1234567890, 1024**4 * 5, None]
    shown = [
        "0 Bytes",
        "500 Bytes",
        "1023 Bytes",
        "1 KB",
        "1.5 KB",
        "1.13 KB",
        "1 MB",
        "1.15 GB",
        "5 TB",
        None,
    ]
    assert column(spark, values, "bigint", G.byte_text(F.col("x"))) == shown


def test_time_texts(spark):
    at = F.lit("2014-01-10 09:15:00.25").cast("timestamp")
    assert column(spark, [1], "int", G.iso_time_text(at)) == ["2014-01-10T09:15:00.250Z"]
    assert column(spark, [3725], "int", G.duration_text(F.col("x"))) == ["1h 62m 3725s"]


def test_row_texts(spark):
    df = spark.sql(
        "SELECT 7L AS id, timestamp'2014-01-10 09:15:00' AS ts, '2014-01-10 09:15:00' AS ts_text, "
        "12.5D AS consumption, 9.71D AS expected"
    )
    c = F.col
    key = G.composite_key(c("id"), F.to_date("ts"), F.hour("ts"))
    row = df.select(
        G.bracket_row(c("id"), c("ts_text"), c("consumption"), c("expected")),
        G.tuple_row(key, c("id"), c("ts_text"), c("consumption")),
        G.message_row(key, c("id"), c("ts"), c("consumption"), c("expected")),
    ).first()
    assert row[0] == "[7,2014-01-10 09:15:00,12.5,9.71]"
    assert row[1] == "(7-2014-10-9,7,2014-01-10 09:15:00,12.5)"
    assert row[2] == (
        "7-2014-10-9, consumption=Consumption{id=7, "
        "measurementTimestamp=Fri Jan 10 09:15:00 UTC 2014, consumption=12.5} expected=9.71"
    )
