"""The model against a row-by-row computation in plain Python."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridtide.operators import model as M
from gridtide.sinks import publish_model, save_model
from gridtide.sources.files import read_lines
from gridtide.sources.models import load_model, parse_model, rejected_model_lines
from gridtide.streaming.detect import model_for

DAY = dt.date(2014, 1, 10)


def readings_of(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"id long, t string, consumption {kind}").select(
        "id", F.to_timestamp("t").alias("ts"), "consumption"
    )


def weather_of(spark, rows):
    return spark.createDataFrame(rows, "date date, hour int, temperature double")


def collected(model):
    return {(r.id, r.date, r.hour): (r.expected, r.n) for r in model.collect()}


@pytest.fixture
def pair(spark):
    readings = readings_of(
        spark, [(7, "2014-01-10 09:05:00", 10.0), (7, "2014-01-10 09:55:00", 14.0)]
    )
    return readings, weather_of(spark, [(DAY, 9, 68.0)])


@pytest.mark.parametrize(
    ("mode", "days", "n"),
    [("literal", [9], 6), ("minus_days", [7, 8, 9], 2), ("trailing", [11, 12, 13], 2)],
)
def test_modes(pair, mode, days, n):
    model = collected(M.build_expected_model(*pair, mode=mode))
    assert model == {(7, dt.date(2014, 1, d), 9): (19.0, n) for d in days}


def test_shift_over_new_year(spark):
    readings = readings_of(spark, [(7, "2014-01-01 00:00:00", 1.0)])
    weather = weather_of(spark, [])
    literal = collected(M.build_expected_model(readings, weather, mode="literal"))
    assert list(literal) == [(7, dt.date(2013, 12, 31), 0)]
    lines = M.model_lines(M.build_expected_model(readings, weather, mode="literal"))
    assert lines.first().value == "7-2013-365-0,8.0"


def test_missing_weather_policies(spark, pair):
    readings, _ = pair
    nothing = weather_of(spark, [(DAY, 10, 0.0)])
    assert set(collected(M.build_expected_model(readings, nothing)).values()) == {(19.0, 2)}
    assert M.build_expected_model(readings, nothing, missing_weather="drop").count() == 0
    with pytest.raises(PySparkException, match="without a temperature"):
        M.build_expected_model(readings, nothing, missing_weather="error").collect()
    known = M.build_expected_model(*pair, missing_weather="error")
    assert set(collected(known).values()) == {(19.0, 2)}


def test_bad_arguments(pair):
    for bad in ({"mode": "daily"}, {"lags": ()}, {"missing_weather": "guess"}):
        with pytest.raises(ValueError):
            M.build_expected_model(*pair, **bad)


def test_null_readings_are_no_readings(spark, pair):
    readings = readings_of(spark, [(7, "2014-01-10 09:05:00", 10.0), (7, "2014-01-10 09:06:00", None)])
    model = collected(M.build_expected_model(readings, pair[1]))
    assert set(model.values()) == {(17.0, 1)}


def brute(rows, weather, lags, mode):
    sums = {}
    for id_, t, consumption in rows:
        ts = dt.datetime.fromisoformat(t)
        hits = weather.get((ts.date(), ts.hour), [None])
        for lag in lags:
            days = {"literal": -1, "minus_days": -lag, "trailing": lag}[mode]
            key = (id_, ts.date() + dt.timedelta(days=days), ts.hour)
            for f in hits:
                factor = Decimal("1.0")
                if f is not None:
                    c = (f - 32) * 5 / 9
                    factor = Decimal(
                        "0.6" if c < 5 else "0.8" if c < 16 else "0.6" if c > 24 else "1.0"
                    )
                total, n = sums.get(key, (Decimal(0), 0))
                sums[key] = (total + consumption * factor + 7, n + 1)
    return {k: (float(total) / n, n) for k, (total, n) in sums.items()}


@pytest.mark.parametrize("mode", M.MODES)
@pytest.mark.parametrize("exact", [True, False])
def test_model_equals_brute_force(spark, mode, exact):
    rng = random.Random(2)
    start = dt.datetime(2014, 12, 29)
    rows = [
        # One id holds a third of the readings, and one hour of it many of those.
        (
            1 if rng.random() < 0.34 else rng.randrange(2, 9),
            str(start + dt.timedelta(minutes=int(rng.random() ** 3 * 6 * 1440))),
            Decimal(rng.randrange(1, 9000)) / 100,
        )
        for _ in range(3000)
    ]
    weather = {}
    for hour in range(7 * 24):
        at = start + dt.timedelta(hours=hour)
        # Some hours without a weather row, some with two.
        weather[(at.date(), at.hour)] = [float(rng.randrange(20, 100)) for _ in range(hour % 3)] or [None]
    flat = [(d, h, f) for (d, h), fs in weather.items() for f in fs if f is not None]
    readings = readings_of(spark, rows, "decimal(10,2)")
    if not exact:
        readings = readings.withColumn("consumption", F.col("consumption").cast("double"))
    lags = (1, 2, 4)
    got = collected(M.build_expected_model(readings, weather_of(spark, flat), lags, mode))
    expected = brute(rows, weather, lags, mode)
    assert got.keys() == expected.keys()
    for key, (mean, n) in expected.items():
        assert got[key][1] == n
        assert got[key][0] == (mean if exact else pytest.approx(mean, rel=1e-12))


def test_literal_is_the_one_lag_model(spark, pair):
    three = collected(M.build_expected_model(*pair, mode="literal"))
    one = collected(M.build_expected_model(*pair, lags=(1,), mode="minus_days"))
    assert {k: v[0] for k, v in three.items()} == {k: v[0] for k, v in one.items()}


def test_row_join_gives_the_same_sums(spark, pair):
    joined = M.join_weather(*pair)
    assert sorted(r.adjusted for r in joined.collect()) == [17.0, 21.0]


@pytest.mark.parametrize("policy", ["neutral", "drop"])
@pytest.mark.parametrize("exact", [True, False])
def test_model_and_row_join_agree_on_missing_temperatures(spark, policy, exact):
    rows = [(k % 3, f"2014-01-{10 + k % 4} {k % 6:02d}:30:00", k * 1.25) for k in range(60)]
    readings = spark.createDataFrame(rows, "id long, t string, consumption double").select(
        "id", F.to_timestamp("t").alias("ts"), F.col("consumption").cast("decimal(8,2)" if exact else "double")
    )
    kinds = [[], [None], [77.0], [None, 77.0], [float("nan")], [40.0, float("nan"), None]]
    hours = [(f"2014-01-{d}", h, t) for d in range(10, 14) for h in range(6) for t in kinds[h]]
    weather = spark.createDataFrame(hours, "d string, hour int, temperature double").select(
        F.to_date("d").alias("date"), "hour", "temperature"
    )
    joined = M.join_weather(readings, weather, policy)
    by_row = joined.groupBy("id", F.date_add("date", 1).alias("date"), "hour").agg(
        F.avg(F.col("adjusted").cast("double")).alias("expected"), F.count("*").alias("n")
    )
    model = M.build_expected_model(readings, weather, lags=[1], missing_weather=policy)
    key = lambda df: {(r.id, r.date, r.hour): (round(r.expected, 6), r.n) for r in df.collect()}
    assert key(model) == key(by_row)


def test_error_policy_fails_on_a_row_without_temperature(spark, pair):
    readings, weather = pair
    gap = weather.withColumn("temperature", F.lit(None).cast("double"))
    for frame in (
        M.join_weather(readings, gap, "error"),
        M.build_expected_model(readings, gap, missing_weather="error"),
    ):
        with pytest.raises(PySparkException, match="without a temperature"):
            frame.collect()


def test_publish_and_load(spark, pair, tmp_path):
    model = M.build_expected_model(*pair)
    path = publish_model(model, str(tmp_path), run_ms=123)
    assert path.endswith("/123")
    assert collected(load_model(spark, path).withColumn("n", F.lit(2))) == collected(model)
    stored = spark.read.parquet(save_model(model, str(tmp_path / "stored")))
    assert collected(stored) == collected(model)


def test_stored_model_reads_only_the_dates_asked_for(spark, pair, tmp_path):
    save_model(M.build_expected_model(*pair), str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    readings = M.with_hour_key(readings_of(spark, [(7, "2014-01-12 09:00:00", 50.0)]))
    part = model_for(readings, stored)
    assert {r.date for r in part.collect()} == {dt.date(2014, 1, 12)}
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString()


def test_loader_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,1\n7-2014-10-9,1\n\nabc\n7-2014-10-9,x\n7-2014-10-9,2\n")
    (tmp_path / "b.csv").write_text("8-2014-10-9,3,more\n7-2014-010-9,9\n8-2014-366-9,9\n7-2014-10-9, 5 \n")
    last = load_model(spark, str(tmp_path))
    assert {(r.id, r.expected) for r in last.collect()} == {(7, 5.0), (8, 3.0)}
    every = load_model(spark, str(tmp_path), "fanout")
    assert sorted(r.expected for r in every.collect()) == [1.0, 2.0, 3.0, 5.0]
    single = load_model(spark, str(tmp_path / "a.csv"))
    assert [(r.id, r.date, r.hour, r.expected) for r in single.collect()] == [(7, DAY, 9, 2.0)]
    rejects = rejected_model_lines(read_lines(spark, str(tmp_path)))
    assert {(r.value, r.reason) for r in rejects.collect()} == {
        ("k,1", "bad key"),
        ("abc", "bad expected value"),
        ("7-2014-10-9,x", "bad expected value"),
        ("7-2014-010-9,9", "bad key"),
        ("8-2014-366-9,9", "bad key"),
    }
    with pytest.raises(ValueError):
        parse_model(read_lines(spark, str(tmp_path)), on_duplicate="first")


def test_one_copy_of_each_partial_crosses_the_network(pair):
    plan = M.build_expected_model(*pair)._jdf.queryExecution().executedPlan().toString()
    after_explode = plan[: plan.index("Generate explode")]
    assert "Exchange" not in after_explode
