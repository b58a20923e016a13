"""Streams over files that arrive one by one, against the batch operators."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.operators import detect as D
from gridtide.operators import densify as N
from gridtide.operators import model as M
from gridtide.operators import windows as W
from gridtide.schemas import CONSUMPTION_CSV
from gridtide.sinks import file_target, save_model
from gridtide.sources.files import read_lines, stream_csv, stream_lines
from gridtide.streaming import (
    detect_each_batch,
    detect_stream,
    interpolate_each_batch,
    records_per_trigger,
    run_measured,
    run_to_end,
    spread,
    trigger,
)
from gridtide.streaming.run import STATE_ROWS, state_partitions

BATCHES = 4
IDS = 6


def arrive(folder, texts):
    """One file per text, with modification times in order."""
    folder.mkdir()
    for i, text in enumerate(texts):
        path = folder / f"part{i}.csv"
        path.write_text(text)
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    return str(folder)


@pytest.fixture
def feed(tmp_path):
    """Hourly readings, in time order; id 0 reports four times an hour."""
    texts = []
    for day in range(1, BATCHES + 1):
        lines = []
        for hour in range(24):
            for id_ in range(IDS):
                for minute in (0, 15, 30, 45) if id_ == 0 else (5 + id_,):
                    value = (day * 7 + hour * 3 + id_ * 5 + minute) % 23 + 0.25
                    lines.append(f"{id_},2014-01-{day:02d} {hour:02d}:{minute:02d}:00,{value}")
        texts.append("\n".join([*lines, "broken line", ""]))
    return arrive(tmp_path / "feed", texts)


def values(df):
    return sorted(r.value for r in df.select("value").collect())


def test_trigger():
    assert trigger(40) == {"processingTime": "40 seconds"}
    assert trigger(None) == {"availableNow": True}
    assert records_per_trigger(200_000, 40) == 8_000_000
    for bad in (lambda: trigger(0), lambda: records_per_trigger(0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_threshold_stream_equals_batch(spark, feed, tmp_path):
    lines = spread(stream_lines(spark, feed, files_per_trigger=1), 3)
    out = str(tmp_path / "out")
    found = run_measured(D.lines_above_limit(lines, 9), file_target(out), str(tmp_path / "cp"))
    assert values(spark.read.parquet(out)) == values(D.lines_above_limit(read_lines(spark, feed), 9))
    totals = found.first()
    assert totals.records == len(read_lines(spark, feed).collect())
    assert totals.shown == str(totals.records)


def test_totals_cover_batches_the_query_has_forgotten(spark, feed, tmp_path):
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        lines = stream_lines(spark, feed, files_per_trigger=1)
        totals = run_measured(lines, file_target(str(tmp_path / "out")), str(tmp_path / "cp")).first()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert totals.records == read_lines(spark, feed).count()
    assert totals.seconds > 0


@pytest.fixture
def model(spark, feed, tmp_path):
    from gridtide.operators.parse import parse_readings

    readings = parse_readings(read_lines(spark, feed))
    weather = spark.createDataFrame([], "date date, hour int, temperature double")
    built = M.build_expected_model(readings, weather, offset=-3)
    return spark.read.parquet(save_model(built, str(tmp_path / "model")))


def test_detection_stream_equals_batch(spark, feed, model, tmp_path):
    batch = values(D.detect_lines(read_lines(spark, feed), model))
    assert batch
    lines = stream_lines(spark, feed, files_per_trigger=1)
    out = str(tmp_path / "each")
    run_to_end(lines, detect_each_batch(model, file_target(out)), str(tmp_path / "cp1"))
    assert values(spark.read.parquet(out)) == batch
    # The first day has no days before it, so its batch has no rows.
    assert spark.read.parquet(out).select("batch").distinct().count() == BATCHES - 1
    out = str(tmp_path / "joined")
    run_to_end(detect_stream(lines, model), file_target(out), str(tmp_path / "cp2"))
    assert values(spark.read.parquet(out)) == batch


READING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("consumption", T.DoubleType()),
    ]
)


def typed(df):
    return df.where("id IS NOT NULL").select("id", F.col("timestamp").alias("ts"), "consumption")


@pytest.mark.parametrize("size", [None, 40])
@pytest.mark.parametrize("id_cols", [["id"], []])
def test_interpolation_stream_equals_batch(spark, feed, tmp_path, size, id_cols):
    interps = [N.Interp("ts", "date"), N.Interp("consumption", "double")]
    readings = typed(stream_csv(spark, feed, CONSUMPTION_CSV, files_per_trigger=1))
    target = file_target(str(tmp_path / "out"))
    writer = interpolate_each_batch(
        READING, 3, interps, id_cols, ["ts", "id"], target, str(tmp_path / "state"), size
    )
    run_to_end(readings, writer, str(tmp_path / "cp"))
    got = spark.read.parquet(target.path)
    assert got.select("batch").distinct().count() == BATCHES
    batch = typed(spark.read.schema(CONSUMPTION_CSV).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(feed))
    expected = N.interpolate(batch, 3, interps, id_cols, ["ts", "id"])
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, expected.collect()))


def test_interpolation_batch_can_be_run_again(spark, tmp_path):
    interps = [N.Interp("v", "double")]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    target = file_target(str(tmp_path / "out"))
    writer = interpolate_each_batch(schema, 2, interps, ["id"], ["v"], target, str(tmp_path / "state"))
    batches = [[(1, 0.0), (2, 5.0)], [(1, 2.0)], [(1, 4.0), (2, 7.0)]]
    for batch_id, rows in enumerate(batches):
        for _ in range(2):
            writer(spark.createDataFrame(rows, schema), batch_id)
    got = spark.read.parquet(target.path).groupBy("batch").agg(F.sort_array(F.collect_list("v")))
    assert {r[0]: r[1] for r in got.collect()} == {1: [0.0, 1.0], 2: [2.0, 3.0, 5.0, 6.0]}


def test_late_arrivals_pair_in_arrival_order(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    target = file_target(str(tmp_path / "out"))
    writer = interpolate_each_batch(
        schema, 2, [N.Interp("v", "double")], ["id"], ["v"], target, str(tmp_path / "state")
    )
    writer(spark.createDataFrame([(1, 8.0)], schema), 0)
    writer(spark.createDataFrame([(1, 4.0)], schema), 1)
    assert sorted(r.v for r in spark.read.parquet(target.path).collect()) == [6.0, 8.0]


def test_watermark_drops_late_rows_and_closes_windows(spark, tmp_path):
    folder = arrive(
        tmp_path / "in",
        [
            "1,2014-01-01 00:10:00,1.0\n1,2014-01-01 05:00:00,2.0\n",
            "1,2014-01-01 09:00:00,8.0\n",
            # Its window was closed by the batch before, so the first row is dropped.
            "1,2014-01-01 00:50:00,4.0\n1,2014-01-01 12:00:00,16.0\n",
        ],
    )
    readings = typed(stream_csv(spark, folder, CONSUMPTION_CSV, files_per_trigger=1))
    hourly = W.tumbling(
        W.with_watermark(readings, "1 hour"), "1 hour", ["id"], [F.sum("consumption").alias("total")]
    )
    out = str(tmp_path / "out")
    run_to_end(hourly, file_target(out), str(tmp_path / "cp"))
    rows = spark.read.parquet(out).select(F.hour("window_start"), "total").collect()
    assert sorted(map(tuple, rows)) == [(0, 1.0), (5, 2.0), (9, 8.0)]


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, "2014-01-01 03:30:00")], "id long, t string").select(
        "id", F.to_timestamp("t").alias("ts")
    )
    got = W.sliding(df, "3 hours", "1 hour", ["id"], [F.count("*").alias("n")])
    assert got.columns == ["id", "window_start", "window_end", "n"]
    assert sorted(r.window_start.hour for r in got.collect()) == [1, 2, 3]


def test_sliding_totals_equal_sliding(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 977).alias("ts"), F.col("id").alias("v")
    )
    plain = W.sliding(df, "3 hours", "1 hour", ["k"], [F.count("*").alias("n"), F.sum("v").alias("v")])
    totals = W.sliding_totals(df, "3 hours", "1 hour", ["k"], {"v": F.col("v")})
    assert totals.columns == plain.columns
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, plain.collect()))


def test_late_rows_equals_brute_force(spark):
    times = [(i * 37) % 101 * 60 for i in range(400)]
    df = spark.createDataFrame(list(enumerate(times)), "seq long, s long").select(
        "seq", F.timestamp_seconds("s").alias("ts")
    )
    expected = [i for i, s in enumerate(times) if i and s < max(times[:i]) - 1800]
    for size in (None, 33):
        got = W.late_rows(df, ["seq"], 1800, rows_per_segment=size)
        assert sorted(r.seq for r in got.collect()) == expected


def test_join_within(spark):
    left = spark.createDataFrame([(1, 100), (2, 100)], "k long, s long").select(
        "k", F.timestamp_seconds("s").alias("a")
    )
    right = spark.createDataFrame([(1, 100), (1, 160), (1, 161), (2, 99)], "k long, s long").select(
        "k", F.timestamp_seconds("s").alias("b")
    )
    got = W.join_within(left, right, ["k"], "a", "b", "60 SECONDS")
    assert got.columns == ["k", "a", "b"]
    assert got.count() == 2


def test_stream_as_sql_view(spark, feed, tmp_path):
    typed(stream_csv(spark, feed, CONSUMPTION_CSV)).createOrReplaceTempView("feed_stream")
    found = spark.sql("SELECT id, consumption FROM feed_stream WHERE consumption > 20")
    run_to_end(found, file_target(str(tmp_path / "out")), str(tmp_path / "cp"))
    batch = typed(spark.read.schema(CONSUMPTION_CSV).csv(feed)).where("consumption > 20")
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_state_has_partitions_by_the_rows_of_the_stream(spark, tmp_path):
    folder = arrive(tmp_path / "in", [f"{i},2024-01-0{i + 1} 00:00:00,1.0\n" for i in range(3)])
    readings = stream_csv(spark, folder, CONSUMPTION_CSV, 1)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    counted = readings.withColumn("at", F.lit("2024-01-01").cast("timestamp")).withWatermark("at", "1 hour").dropDuplicates([readings.columns[0], "at"])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        run_to_end(counted, file_target(f"{tmp_path}/rows"), f"{tmp_path}/progress", rows=3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        assert state_partitions(spark, 10**9) == 40
        assert state_partitions(spark, 20 * STATE_ROWS) == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 3
    assert len([d for d in os.listdir(f"{tmp_path}/progress/state/0") if d.isdigit()]) == spark.sparkContext.defaultParallelism


def test_what_is_kept_between_steps_has_few_partitions(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        kept = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count().persist()
        assert kept.count() == 100
        assert kept.rdd.getNumPartitions() < 10
        kept.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
