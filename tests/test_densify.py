import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridtide.operators import densify as N
from gridtide.operators import replay as R
from gridtide.operators.order import with_next


def test_multiply(spark):
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    assert sorted(r.value for r in N.multiply(df, 3).collect()) == list("aaabbb")
    assert sorted(r.value for r in N.multiply(df, 1).collect()) == list("ab")
    assert N.multiply(df, 0).count() == 0
    assert N.densify(df, N.NONE).count() == 2
    assert N.densify(df, 9, 5).count() == 2
    assert N.densify(df, N.MULTIPLY, 4).count() == 8


def chain(spark, *values, kind="double"):
    rows = [(1, i, v, f"note{i}") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"id long, seq int, v {kind}, note string")


def values_of(df, n, kind, **kwargs):
    dense = N.interpolate(df, n, [N.Interp("v", kind, **kwargs)], ["id"], ["seq"])
    return [r.v for r in dense.orderBy("seq", "v").collect()]


def test_double_kernel(spark):
    got = values_of(chain(spark, 1.0, 2.0), 3, "double")
    assert got == [1.0, 1.3333333333333333, 1.6666666666666665]


def test_whole_number_kernels_cut_towards_zero(spark):
    for kind, column in (("integer", "int"), ("long", "bigint")):
        dense = N.interpolate(chain(spark, 5, 2, kind=column), 2, [N.Interp("v", kind)], ["id"], ["seq"])
        assert sorted(r.v for r in dense.collect()) == [4, 5]
    assert sorted(values_of(chain(spark, 0, -7, kind="bigint"), 4, "long")) == [-5, -3, -1, 0]


def test_date_kernel(spark):
    df = chain(spark, "2014-01-01 00:00:00", "2014-01-01 00:00:01", kind="string")
    df = df.withColumn("v", F.to_timestamp("v"))
    assert values_of(df, 3, "date", fmt="HH:mm:ss") == ["00:00:00"] * 3
    millis = [t.microsecond // 1000 for t in values_of(df, 3, "date")]
    assert millis == [0, 333, 666]


def test_other_columns_come_from_the_earlier_record(spark):
    dense = N.interpolate(chain(spark, 0.0, 4.0, 8.0), 2, [N.Interp("v", "double")], ["id"], ["seq"])
    assert dense.columns == ["id", "seq", "v", "note"]
    assert sorted((r.v, r.note) for r in dense.collect()) == [
        (0.0, "note0"),
        (2.0, "note0"),
        (4.0, "note1"),
        (6.0, "note1"),
    ]


def test_single_record_has_no_output(spark):
    assert values_of(chain(spark, 1.0), 4, "double") == []


def test_guards(spark):
    df = chain(spark, 1.0, 2.0)
    with pytest.raises(ValueError, match="at least one interpolator"):
        N.interpolate(df, 4, [], ["id"], ["seq"])
    with pytest.raises(ValueError, match="at least 2 steps"):
        N.interpolate(df, 1, [N.Interp("v", "double")], ["id"], ["seq"])
    with pytest.raises(ValueError, match="unknown kind"):
        N.Interp("v", "text")


def test_specs():
    assert N.parse_spec("2;DOUBLE") == N.FieldInterp(2, "double", None)
    assert N.parse_spec("1;Date;yyyy-MM-dd") == N.FieldInterp(1, "date", "yyyy-MM-dd")
    assert N.parse_spec("1;colour") is None
    for bad in ("0", "0;date"):
        with pytest.raises(ValueError):
            N.parse_spec(bad)


def lines_of(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "seq int, value string")


def dense_lines(df, n, specs, **kwargs):
    return sorted(r.value for r in N.interpolate_lines(df, n, specs, ["seq"], **kwargs).collect())


def test_lines_by_position(spark):
    df = lines_of(
        spark,
        "7,2014-01-10 00:00:00,1.0,5,x",
        "8,2014-01-10 00:00:00,9.0,0,z",
        "7,2014-01-10 00:00:10,2.0,2,y",
    )
    specs = ["1;date;yyyy-MM-dd HH:mm:ss", "2;Double", "3;integer", "0;unknown"]
    assert dense_lines(df, 2, specs, id_position=0) == [
        "7,2014-01-10 00:00:00,1.0,5,x",
        "7,2014-01-10 00:00:05,1.5,4,x",
    ]


def test_lines_without_id_are_one_chain(spark):
    df = lines_of(spark, "1,0", "2,10", "3,20")
    assert dense_lines(df, 2, ["1;long"]) == ["1,0", "1,5", "2,10", "2,15"]


SHORT = ["1,2024-01-01 00:00:00,9.0", "1,2024-01-01 00:10:00", "1,2024-01-01 00:20:00,x", "1,2024-01-01 00:30:00,3.0"]


def test_a_missing_field_fails_or_is_rejected(spark):
    lines = spark.createDataFrame(list(enumerate(SHORT)), "n int, value string")
    for bad in (lines.where("n < 2"), lines.where("n IN (1, 3)"), lines.where("n >= 2")):
        with pytest.raises(PySparkException):
            N.interpolate_lines(bad, 2, ["2;double"], ["n"], id_position=0).collect()
    dense = N.interpolate_lines(lines, 2, ["2;double"], ["n"], id_position=0, mode="permissive")
    assert sorted(r.value for r in dense.collect()) == [
        "1,2024-01-01 00:00:00,6.0",
        "1,2024-01-01 00:00:00,9.0",
    ]
    rejects = N.rejected_dense_lines(lines, ["2;double"]).collect()
    assert sorted(r.value for r in rejects) == SHORT[1:3]
    assert {r.reason for r in rejects} == {"bad field 2"}


def test_trailing_empty_fields_are_dropped(spark):
    df = lines_of(spark, "1,a,,", "3,b,,")
    assert dense_lines(df, 2, ["0;long"]) == ["1,a", "2,a"]


def test_later_spec_for_a_position_counts(spark):
    df = lines_of(spark, "0", "1")
    assert dense_lines(df, 2, ["0;long", "0;double"]) == ["0.0", "0.5"]


def test_only_unknown_specs_copy_the_earlier_record(spark):
    assert dense_lines(lines_of(spark, "a", "b"), 2, ["0;colour"]) == ["a", "a"]
    assert dense_lines(lines_of(spark, "a", "b"), 0, ["0;colour"]) == []


def test_hot_id_properties(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 20), i, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, seq long, v double")
    n = 5
    plain = N.interpolate(df, n, [N.Interp("v", "double")], ["id"], ["seq"])
    cut = N.interpolate(df, n, [N.Interp("v", "double")], ["id"], ["seq"], rows_per_segment=100)
    assert plain.count() == n * (len(rows) - len({r[0] for r in rows}))
    assert plain.exceptAll(cut).count() == 0
    assert cut.exceptAll(plain).count() == 0
    earlier = with_next(df, ["id"], ["seq"], ["v"]).where("next IS NOT NULL").drop("next")
    assert earlier.exceptAll(cut).count() == 0


def test_custom_kernel(spark):
    df = chain(spark, 1.0, 3.0, 2.0)
    kernels = {"v": lambda a, b, i, n: F.greatest(a["v"], b["v"]) + i}
    dense = N.interpolate_with(df, 2, kernels, ["id"], ["seq"])
    assert sorted(r.v for r in dense.collect()) == [3.0, 3.0, 4.0, 4.0]


def test_send_slots(spark):
    df = spark.range(1005).withColumnRenamed("id", "seq")
    slots = R.send_slots(df, 100, ["seq"], rows_per_segment=90).groupBy("slot").count().collect()
    assert {r.slot: r["count"] for r in slots} == {**dict.fromkeys(range(10), 100), 10: 5}
    with pytest.raises(ValueError):
        R.send_slots(df, 0, ["seq"])


def test_markers_and_records(spark):
    at = F.lit("2014-01-10 09:15:00.25").cast("timestamp")
    df = lines_of(spark, "a", "b", "a")
    marks = R.marker_records(df, "a", at=at).collect()
    assert [tuple(r) for r in marks] == [
        ("timer", "1389345300250", "GENERATED: 2014-01-10T09:15:00.250Z")
    ] * 2
    assert {r.key for r in R.send_records(df, at=at).collect()} == {"1389345300250"}
    assert int(R.send_records(df).first().key) > 1_600_000_000_000


def test_totals(spark):
    df = spark.range(1234).withColumn("ts", F.timestamp_seconds(F.col("id") * 3))
    assert tuple(R.run_totals(df).first()) == (1234, "1.2k")
    row = R.timed_totals(df, F.col("ts"), F.col("ts")).first()
    assert (row.records, row.shown, row.duration) == (1234, "1.2k", "1h 61m 3699s")
