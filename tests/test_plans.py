"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from gridtide.plans import QUERIES
from gridtide.operators import detect as D
from gridtide.operators.densify import interpolate_lines
from gridtide.sources.files import LINE_ORDER, read_lines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if not n.startswith("stream_"))
)
def test_no_cross_join_and_no_window_over_everything(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # A window's definition starts with what it is partitioned by.  The one over the
    # bounded table of segments may run without; everything else is cut by a column.
    for start in re.findall(r"windowspecdefinition\((\S+ ?\S*)", plan):
        assert re.match(r"\w+#\d+L?, ", start + " ") or start.startswith(("_segment#", "_range#")), start


def test_scan_reads_only_what_the_query_needs(spark, sf_dir):
    plan = plan_of(QUERIES["threshold_lines"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    plan = plan_of(QUERIES["threshold_anomalies"](spark, sf_dir))
    assert "GreaterThan(value,5.0)" in plan


def test_hot_hour_is_split_in_the_join(spark):
    """A third of all readings has one key; adaptive execution splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        id_ = F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n") % 5000)
        # Few equal values, so the shuffled rows do not compress away.
        readings = spark.range(0, 300_000, 1, 8).withColumnRenamed("id", "n").select(
            id_.cast("bigint").alias("id"),
            F.lit("2014-01-10 09:15:00").cast("timestamp").alias("ts"),
            (F.rand(1) * 100).alias("consumption"),
        )
        model = spark.range(5000).select(
            "id",
            F.lit("2014-01-10").cast("date").alias("date"),
            F.lit(9).alias("hour"),
            F.lit(50.0).alias("expected"),
        )
        found = D.detect(readings, model)
        assert found.count() == readings.where("consumption > 50").count()
        found.collect()
        assert "skew=true" in plan_of(found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_the_model_is_planned_without_a_job(spark, sf_dir):
    from gridtide.operators import model as M
    from gridtide.sources import tables

    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    readings, weather = tables.events(spark, sf_dir), tables.weather(spark, sf_dir)
    read = len(tracker.getJobIdsForGroup(None))
    M.build_expected_model(readings, M.weather_hours(weather)).explain()
    assert len(tracker.getJobIdsForGroup(None)) == read
    assert read >= before


@pytest.mark.parametrize("size", [None, 7])
def test_pairs_cross_file_boundaries_in_listing_order(spark, tmp_path, size):
    (tmp_path / "b").write_text("".join(f"{i % 3},{100 + i}\n" for i in range(30)))
    (tmp_path / "a").write_text("".join(f"{i % 3},{i}\n" for i in range(30)))
    lines = read_lines(spark, str(tmp_path))
    dense = interpolate_lines(
        lines, 2, ["1;long"], LINE_ORDER, id_position=0, rows_per_segment=size
    )
    expected = []
    values = [*range(30), *range(100, 130)]
    for id_ in range(3):
        chain = [v for v in values if (v % 100) % 3 == id_]
        for a, b in zip(chain, chain[1:], strict=False):
            expected += [f"{id_},{a}", f"{id_},{a + (b - a) // 2}"]
    assert sorted(r.value for r in dense.collect()) == sorted(expected)
