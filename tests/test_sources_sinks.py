import pytest
from pyspark.sql import functions as F

from gridtide import session as S
from gridtide.schemas import CONSUMPTION_COLUMNS, CONSUMPTION_CSV, WEATHER_CSV
from gridtide.sinks import file_target, topic_target, write_batch
from gridtide.sources import datasets, files, topics


def test_csv_declared_and_inferred(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("7,2014-01-10 09:15:00,12.5\n8,2014-01-11 10:00:00,3.0\n")
    declared = files.read_csv(spark, str(path), CONSUMPTION_CSV)
    inferred = files.read_csv(spark, str(path), names=CONSUMPTION_COLUMNS)
    assert declared.columns == inferred.columns == CONSUMPTION_COLUMNS
    assert [r.consumption for r in declared.orderBy("id").collect()] == [12.5, 3.0]
    assert inferred.select(F.hour("timestamp")).orderBy("id").first()[0] == 9


def test_weather_csv_reads_two_columns_only(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("68.0,clear,0.5,10,Clear,68,1015,3,0.1,1389345300,200,0,50,0\n")
    weather = files.read_csv(spark, str(path), WEATHER_CSV).select("temperature", "timestamp")
    assert tuple(weather.first()) == (68.0, 1389345300)
    plan = weather._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<temperature:double,timestamp:bigint>" in plan


def test_lines_keep_file_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(50)))
    lines = files.read_lines(spark, str(tmp_path)).orderBy(*files.LINE_ORDER)
    assert [r.value for r in lines.collect()] == [f"{n}{i}" for n in "ab" for i in range(50)]


def test_catalog(spark, tmp_path):
    (tmp_path / "one.csv").write_text("1,x\n\n2,y\n3\n4\n5\n6\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "below").mkdir()
    (tmp_path / "crlf.csv").write_bytes(b"a\r\nb\r\n" + b"c" * 2000)
    rows = {r.dataset_name: r for r in datasets.catalog(spark, str(tmp_path)).collect()}
    assert rows["one.csv"].preview == ["1,x", "2,y", "3", "4"]
    assert (rows["one.csv"].size, rows["one.csv"].shown_size) == (17, "17 Bytes")
    assert (rows["empty.csv"].preview, rows["empty.csv"].size) == ([], 0)
    assert rows["crlf.csv"].preview == ["a", "b", "c" * 2000]
    assert rows["crlf.csv"].shown_size == "1.96 KB"
    assert len(rows) == 3


def test_catalog_of_folders_with_part_files(spark, tmp_path):
    (tmp_path / "a+b c").mkdir()
    (tmp_path / "a+b c" / "part-1").write_text("3\n4\n")
    (tmp_path / "a+b c" / "part-0").write_text("1\n2\n")
    row = datasets.catalog(spark, str(tmp_path) + "/", lines_shown=3).first()
    assert (row.dataset_name, row.size, row.preview) == ("a+b c", 8, ["1", "2", "3"])


def test_file_targets_pass_their_options_on(spark, tmp_path):
    target = file_target(str(tmp_path / "out"), "csv", sep=";", header="true")
    write_batch(spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1), target, batch_id=0)
    text = "".join(f.read_text() for f in (tmp_path / "out" / "batch=0").glob("part-*"))
    assert text == "a;b\n1;2\n"


def test_another_session_keeps_its_settings(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Europe/Prague")
    other.conf.set("spark.sql.shuffle.partitions", "5")
    pinned = S.pinned_session(other)
    assert other.conf.get("spark.sql.session.timeZone") == "Europe/Prague"
    assert pinned.conf.get("spark.sql.session.timeZone") == "UTC"
    assert pinned.conf.get("spark.sql.shuffle.partitions") == "5"
    assert S.pinned_session(pinned) is pinned


def test_preview_of_lines(spark):
    rows = [("a", i, v) for i, v in enumerate(["1,x", "", "2,y", "3", "4", "5"])] + [("b", 0, "")]
    df = spark.createDataFrame(rows, "d string, n int, value string")
    shown = {r.d: r.preview for r in datasets.preview(df, "d", ["n"]).collect()}
    assert shown == {"a": ["1,x", "2,y", "3", "4"], "b": []}


def test_preview_ranks_before_the_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("d"), F.col("id").alias("n"), F.col("id").cast("string").alias("value")
    )
    plan = datasets.preview(df, "d", ["n"])._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below_exchange


def test_endpoints():
    assert S.Endpoints.from_env({}) == S.Endpoints("localhost:9092", "hdfs://localhost:9000")
    given = S.Endpoints.from_env({"KAFKA_IP_PORT": "k:1", "HDFS_IP_PORT": "h:2"})
    assert given == S.Endpoints("k:1", "hdfs://h:2")


def test_topic_options():
    options = topics.topic_options("a, b", servers="k:1", records_per_trigger=500, extra={"x": "y"})
    assert options == {
        "kafka.bootstrap.servers": "k:1",
        "subscribe": "a,b",
        "maxOffsetsPerTrigger": "500",
        "x": "y",
    }
    target = topic_target(servers="k:1", extra={"kafka.acks": "1"})
    assert (target.format, target.path) == ("kafka", None)
    assert target.options == {
        "kafka.bootstrap.servers": "k:1",
        "topic": "anomalies",
        "kafka.acks": "1",
    }


def test_batch_files_are_replaced_on_a_rerun(spark, tmp_path):
    target = file_target(str(tmp_path / "out"))
    for _ in range(2):
        write_batch(spark.range(3), target, batch_id=4)
    write_batch(spark.range(2), target, batch_id=5)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in got} == {4: 3, 5: 2}


def test_scratch_folder(spark):
    a, b = S.scratch_folder(spark, "x"), S.scratch_folder(spark, "x")
    assert a != b
    assert a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


class _Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key):
        assert key == "spark.checkpoint.dir"
        return self.folder


class _Context:
    master = "spark://somewhere:7077"

    def __init__(self, folder):
        self.folder = folder

    def getConf(self):
        return _Conf(self.folder)

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, folder):
        self.sparkContext = _Context(folder)


def test_scratch_folder_on_a_cluster_is_the_named_one():
    assert S.scratch_folder(_Session("hdfs://shared/tmp/"), "x").startswith("hdfs://shared/tmp/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.scratch_folder(_Session(None), "x")
