import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridtide.operators import detect as D
from gridtide.operators import parse as P
from gridtide.operators.pipelines import job, job_names, register_job


def lines_of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


GOOD = "7,2014-01-10 09:15:00,12.5"
BAD = {
    "x,2014-01-10 09:15:00,1": "bad id",
    "7,2014-02-30 25:61:00,1": "bad timestamp",
    "7,2014-1-2 3:4:5,1": "bad timestamp",
    "7,2014-01-10 09:15:00,abc": "bad consumption",
    "7,2014-01-10 09:15:00": "bad consumption",
    "7": "bad timestamp",
    "": "bad id",
}


def test_permissive_keeps_good_and_reports_bad(spark):
    lines = lines_of(spark, GOOD, " 8 ,2014-01-10 09:15:00, 5.5 ,extra", *BAD)
    good = P.parse_readings(lines).orderBy("id").collect()
    assert [(r.id, r.ts_text, r.consumption) for r in good] == [
        (7, "2014-01-10 09:15:00", 12.5),
        (8, "2014-01-10 09:15:00", 5.5),
    ]
    assert {r.value: r.reason for r in P.rejected_lines(lines).collect()} == BAD


def test_strict_fails(spark):
    assert P.parse_readings(lines_of(spark, GOOD), mode="strict").count() == 1
    with pytest.raises(PySparkException, match="bad timestamp"):
        P.parse_readings(lines_of(spark, GOOD, "7,nope,1"), mode="strict").collect()
    with pytest.raises(ValueError, match="unknown mode"):
        P.parse_readings(lines_of(spark, GOOD), mode="lenient")


def test_threshold_is_strict_and_ignores_nan(spark):
    lines = lines_of(spark, "1,a,5.0", "2,b,5.01", "3,c,NaN", "4,d", "5,e,7,f", "6,g,x")
    found = D.lines_above_limit(lines)
    assert sorted(r.value for r in found.collect()) == ["2,b,5.01", "5,e,7,f"]
    assert sorted(r.value for r in D.lines_above_limit(found).collect()) == ["2,b,5.01", "5,e,7,f"]
    with pytest.raises(PySparkException):
        D.lines_above_limit(lines, mode="strict").collect()
    readings = spark.createDataFrame([(1, 5.0), (2, 5.01), (3, float("nan"))], "id long, consumption double")
    assert [r.id for r in D.above_limit(readings).collect()] == [2]


@pytest.fixture
def readings(spark):
    rows = [
        (1, "2014-01-10 09:15:00", 10.0),
        (1, "2014-01-10 09:45:00", 10.1),
        (2, "2014-01-10 09:15:00", 99.0),
        (3, "2014-01-10 09:15:00", float("nan")),
        (4, "2014-01-10 09:15:00", 5.0),
    ]
    return spark.createDataFrame(rows, "id long, ts_text string, consumption double").withColumn(
        "ts", F.to_timestamp("ts_text")
    )


def model_of(spark, *rows):
    return spark.createDataFrame(rows, "id long, d string, hour int, expected double").select(
        "id", F.to_date("d").alias("date"), "hour", "expected"
    )


def test_unmatched_equal_and_nan_are_no_anomalies(spark, readings):
    model = model_of(spark, *[(i, "2014-01-10", 9, 10.0) for i in (1, 3, 4)], (2, "2014-01-10", 8, 1.0))
    found = D.detect(readings, model).collect()
    assert [(r.id, r.consumption, r.expected) for r in found] == [(1, 10.1, 10.0)]
    assert D.with_expected(readings, model).count() == 5
    looked_up = D.detect_by_lookup(readings, model).collect()
    assert sorted(map(str, looked_up)) == sorted(map(str, found))


def test_duplicate_keys_fan_out(spark, readings):
    model = model_of(spark, (2, "2014-01-10", 9, 1.0), (2, "2014-01-10", 9, 2.0))
    assert sorted(r.expected for r in D.detect(readings, model).collect()) == [1.0, 2.0]


def test_detection_is_one_inner_join(spark, readings):
    model = model_of(spark, (1, "2014-01-10", 9, 10.0))
    plan = D.detect(readings, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan
    assert "LeftOuter" not in plan


def test_render_forms(spark, readings):
    model = model_of(spark, (2, "2014-01-10", 9, 1.0))
    found = D.detect(readings, model)
    assert D.render_anomalies(found, "bracket").first().value == "[2,2014-01-10 09:15:00,99.0,1.0]"
    assert D.render_anomalies(found, "message").first().key == "2-2014-10-9"
    with pytest.raises(ValueError, match="unknown form"):
        D.render_anomalies(found, "json")


def test_user_jobs(spark):
    register_job("shout", lambda df: df.withColumn("value", F.upper("value")))
    assert {"shout", "threshold"} <= set(job_names())
    out = lines_of(spark, "1,a,6", "1,a,1").transform(job("threshold")).transform(job("shout"))
    assert [r.value for r in out.collect()] == ["1,A,6"]
    with pytest.raises(KeyError):
        job("nothing")
