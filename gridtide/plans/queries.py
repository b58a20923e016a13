"""Registered queries: each takes (session, table folder) and returns a frame.

All of them run over whole tables.  Means are shown to three decimals, cut the
same way as in the SQL twin; instants are shown as epoch milliseconds or text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions import (
    byte_text,
    celsius,
    composite_key,
    count_text,
    date_parts,
    epoch_millis,
    key_columns,
)
from gridtide.operators import detect as D
from gridtide.operators import model as M
from gridtide.operators import parse as P
from gridtide.operators.densify import (
    INTERPOLATE,
    MULTIPLY,
    NONE,
    Interp,
    densify,
    interpolate,
    interpolate_lines,
    interpolate_with,
    multiply,
    rejected_dense_lines,
)
from gridtide.operators.increments import ModelStore
from gridtide.operators.pipelines import job, register_job
from gridtide.operators.replay import (
    marker_records,
    run_totals,
    send_records,
    send_slots,
    timed_totals,
)
from gridtide.operators.windows import (
    join_within,
    late_rows,
    sliding_totals,
    tumbling,
    with_watermark,
)
from gridtide.schemas import CONSUMPTION_CSV, TIMESTAMP_FORMAT, WEATHER_CSV
from gridtide.session import pinned_session, scratch_folder
from gridtide.sinks import (
    file_target,
    noted_batches,
    publish_model,
    save_model,
    write_split,
    write_with_totals,
)
from gridtide.sources import tables
from gridtide.sources.datasets import catalog, preview
from gridtide.sources.files import read_csv, read_lines, stream_csv, stream_lines
from gridtide.sources.models import load_model, parse_model, rejected_model_lines
from gridtide.streaming import (
    detect_each_batch,
    divert_late,
    interpolate_each_batch,
    replay,
    run_measured,
    run_to_end,
    store_slots,
)
from gridtide.streaming.detect import model_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORDER = ["ts", "event_id"]
COPIES = 8
STEPS = 4
RECORDS_PER_SECOND = 1_000
SEGMENT_ROWS = 300
FEED_BATCHES = 4
LOG_BATCHES = 20
LATE_SECONDS = 3600
HOT_LIMIT = 100
DAILY_ADDITIONS = 2
INTERVALS = 4
FILES_PER_BATCH = 2
ARRIVAL = "_arrival"


def _registered(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(pinned_session(spark), sf_dir)

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


def _to_3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def _ts_text(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_FORMAT)


def _key(df: DataFrame) -> Column:
    return composite_key(df["id"], df["date"], df["hour"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_lines(tables.events(spark, sf_dir))


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weather_hours(tables.weather(spark, sf_dir))


def _model(spark: SparkSession, sf_dir: str, mode: str = "trailing", **kwargs) -> DataFrame:
    readings = tables.exact(tables.events(spark, sf_dir))
    return M.build_expected_model(readings, _weather(spark, sf_dir), mode=mode, **kwargs)


def _published(spark: SparkSession, sf_dir: str, mode: str = "trailing") -> DataFrame:
    """The model as a detection job gets it: published as text, two decimals, and loaded."""
    path = publish_model(_model(spark, sf_dir, mode), scratch_folder(spark, "expected"))
    return load_model(spark, path, on_duplicate="fanout")


# ---- scans, parsing, scalar functions -------------------------------------


@_registered
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings written as header-less CSV and read with a declared schema."""
    path = scratch_folder(spark, "csv")
    _lines(spark, sf_dir).select("value").write.text(path)
    df = read_csv(spark, path, CONSUMPTION_CSV)
    return df.select("id", epoch_millis(F.col("timestamp")).alias("ts_ms"), "consumption")


@_registered
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-empty lines of a directory of text files."""
    path = scratch_folder(spark, "lines")
    _lines(spark, sf_dir).select("value").write.text(path)
    return P.non_empty(read_lines(spark, path)).select("value")


def _damaged_columns(ts_text: Column) -> list[Column]:
    """The fields of a line, one of them spoilt where the event is of certain types."""
    kind = F.col("event_type")
    id_ = F.when(kind == "error", "meter").otherwise(F.col("id").cast("string"))
    ts = F.when(kind == "signup", "2024-02-30 25:61:00").otherwise(ts_text)
    return [id_, ts, F.col("consumption")]


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading lines, with one field spoilt where the event is of certain types."""
    readings = tables.events(spark, sf_dir)
    return readings.select(F.concat_ws(",", *_damaged_columns(_ts_text(F.col("ts")))).alias("value"))


@_registered
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good lines, typed."""
    good = P.parse_readings(_damaged(spark, sf_dir))
    return good.select("id", "ts_text", epoch_millis(F.col("ts")).alias("ts_ms"), "consumption")


@_registered
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the reject channel."""
    return P.rejected_lines(_damaged(spark, sf_dir))


@_registered
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key text, its parts, and the parts read back from the text."""
    keyed = M.with_hour_key(tables.events(spark, sf_dir))
    with_key = keyed.withColumn("key", _key(keyed)).withColumns(date_parts(F.col("ts")))
    back = key_columns(F.col("key"))
    return with_key.select(
        "event_id",
        "key",
        "year",
        "day_of_year",
        "hour",
        back["id"].alias("key_id"),
        F.date_format(back["date"], "yyyy-MM-dd").alias("key_date"),
    )


@_registered
def weather_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date parts of epoch seconds; Fahrenheit to Celsius."""
    weather = tables.weather(spark, sf_dir)
    parts = date_parts(F.timestamp_seconds("timestamp"))
    return weather.withColumns(parts).select(
        "timestamp",
        "year",
        "day_of_year",
        "hour",
        celsius(F.col("temperature")).alias("celsius"),
    )


@_registered
def weather_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weather file of fourteen columns without header, of which two are read."""
    given = tables.weather(spark, sf_dir)
    others = {n: F.lit(None).cast("string") for n in WEATHER_CSV.names if n not in given.columns}
    path = scratch_folder(spark, "weather")
    given.withColumns(others).select(*WEATHER_CSV.names).write.csv(path)
    return read_csv(spark, path, WEATHER_CSV).select("timestamp", "temperature")


@_registered
def count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of very different size, as text."""
    n = F.round(F.col("consumption") * 100).cast("bigint") * F.col("event_id") * F.when(
        F.col("event_type") == "error", -1
    ).otherwise(1)
    readings = tables.events(spark, sf_dir)
    return readings.select("event_id", n.alias("n")).withColumn("shown", count_text(F.col("n")))


@_registered
def byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document, alone and times its id, as text."""
    size = F.octet_length("text")
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id",
        byte_text(size).alias("shown"),
        byte_text(size.cast("bigint") * F.col("doc_id")).alias("shown_scaled"),
    )


# ---- the model -------------------------------------------------------------


@_registered
def weather_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the hour's temperature and the adjusted value."""
    readings = tables.exact(tables.events(spark, sf_dir))
    joined = M.join_weather(readings, _weather(spark, sf_dir))
    return joined.select(
        "event_id",
        "temperature",
        F.col("factor").cast("double").alias("factor"),
        F.col("adjusted").cast("double").alias("adjusted"),
    )


def _weather_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some hours without a number for the temperature, some with a second row without any."""
    weather = _weather(spark, sf_dir)
    odd = F.when(F.col("hour") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("temperature"))
    second = weather.where(F.col("hour") % 5 == 0).withColumn("temperature", F.lit(None).cast("double"))
    return weather.withColumn("temperature", odd).unionByName(second)


def _join_gaps(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    readings = tables.exact(tables.events(spark, sf_dir))
    joined = M.join_weather(readings, _weather_with_gaps(spark, sf_dir), policy)
    return joined.select("event_id", F.col("adjusted").cast("double").alias("adjusted"))


@_registered
def join_gaps_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and unreadable temperatures count as neutral."""
    return _join_gaps(spark, sf_dir, "neutral")


@_registered
def join_gaps_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather rows without a temperature are no rows."""
    return _join_gaps(spark, sf_dir, "drop")


@_registered
def hourly_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: sum and count per id and hour."""
    partials = M.hourly_partials(tables.exact(tables.events(spark, sf_dir)))
    return partials.select(
        _key(partials).alias("key"), F.col("total").cast("double").alias("total"), "n"
    )


def _shown(model: DataFrame) -> DataFrame:
    return model.select(_key(model).alias("key"), _to_3(F.col("expected")).alias("expected"), "n")


@_registered
def model_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3: every lag is one day back."""
    return _shown(_model(spark, sf_dir, "literal"))


@_registered
def model_minus_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3: a day's readings feed the three days before it."""
    return _shown(_model(spark, sf_dir, "minus_days"))


@_registered
def model_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3: a day averages the three days before it."""
    return _shown(_model(spark, sf_dir, "trailing"))


@_registered
def model_known_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: readings without a weather row left out."""
    return _shown(_model(spark, sf_dir, missing_weather="drop"))


def _model_gaps(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    readings = tables.exact(tables.events(spark, sf_dir))
    gaps = _weather_with_gaps(spark, sf_dir)
    return _shown(M.build_expected_model(readings, gaps, missing_weather=policy))


@_registered
def model_gaps_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: the model agrees with the row-wise join, ``neutral``."""
    return _model_gaps(spark, sf_dir, "neutral")


@_registered
def model_gaps_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: the model agrees with the row-wise join, ``drop``."""
    return _model_gaps(spark, sf_dir, "drop")


@_registered
def model_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 on double readings, shown to three decimals."""
    model = M.build_expected_model(tables.events(spark, sf_dir), _weather(spark, sf_dir))
    # Not cut at a half, where the last bit of a double sum would decide.
    cut = F.floor(F.col("expected") * 1000 + 0.4123) / 1000
    return model.select(_key(model).alias("key"), cut.alias("expected"), "n")


@_registered
def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, P10: the published lines."""
    return M.model_lines(_model(spark, sf_dir))


@_registered
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model published to a folder and loaded from it."""
    path = publish_model(_model(spark, sf_dir), scratch_folder(spark, "expected"))
    model = load_model(spark, path)
    return model.select(_key(model).alias("key"), "expected")


def _model_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of two models, one after the other, and one of empty and malformed lines, some per id."""
    root = scratch_folder(spark, "model-lines")
    M.model_lines(_model(spark, sf_dir, "trailing")).write.text(f"{root}/1")
    M.model_lines(_model(spark, sf_dir, "minus_days")).write.text(f"{root}/2")
    ids = tables.events(spark, sf_dir).select(F.col("id").cast("string").alias("id")).distinct()
    odd = F.array(F.lit(""), F.col("id"), F.concat("id", F.lit("-2014-010-9,2.5")), F.concat(F.lit("m"), "id", F.lit(",1.5")))
    ids.select(F.explode(odd).alias("value")).write.text(f"{root}/3")
    return [f"{root}/{k}" for k in (1, 2, 3)]


@_registered
def model_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two lines for a key the one in the later file counts."""
    model = load_model(spark, _model_files(spark, sf_dir))
    return model.select(_key(model).alias("key"), "expected")


@_registered
def model_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed model lines, with the reason."""
    return rejected_model_lines(read_lines(spark, _model_files(spark, sf_dir)))


# ---- detection -------------------------------------------------------------


@_registered
def threshold_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 on typed readings."""
    found = D.above_limit(tables.events(spark, sf_dir))
    return found.select("event_id", "id", epoch_millis(F.col("ts")).alias("ts_ms"), "consumption")


@_registered
def threshold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, R4 on text lines."""
    return D.lines_above_limit(_lines(spark, sf_dir)).select("value")


def _cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading lines; of certain types of events they end early or hold no number."""
    readings = tables.events(spark, sf_dir)
    kind = F.col("event_type")
    last = F.when(kind == "signup", "n/a").when(kind != "error", F.col("consumption").cast("string"))
    text = F.concat_ws(",", "id", _ts_text(F.col("ts")), last)
    return readings.select(text.alias("value"), "ts", "event_id")


@_registered
def threshold_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, O3: lines whose third field cannot be compared."""
    return D.rejected_limit_lines(_cut_lines(spark, sf_dir))


def _detected(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    found = D.detect(tables.events(spark, sf_dir), _model(spark, sf_dir, mode))
    return found.select(
        "event_id",
        "id",
        epoch_millis(F.col("ts")).alias("ts_ms"),
        "consumption",
        _to_3(F.col("expected")).alias("expected"),
    )


@_registered
def detect_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, F2 against the literal model."""
    return _detected(spark, sf_dir, "literal")


@_registered
def detect_minus_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, F2 against the minus_days model."""
    return _detected(spark, sf_dir, "minus_days")


@_registered
def detect_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, F2 against the trailing model."""
    return _detected(spark, sf_dir, "trailing")


@_registered
def expected_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 alone: every reading, with an expectation where the model has one."""
    joined = D.with_expected(tables.events(spark, sf_dir), _model(spark, sf_dir))
    return joined.select("event_id", "consumption", _to_3(F.col("expected")).alias("expected"))


@_registered
def detect_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with duplicate keys: a reading comes out once per model row it exceeds."""
    model = parse_model(read_lines(spark, _model_files(spark, sf_dir)), on_duplicate="fanout")
    found = D.detect(tables.events(spark, sf_dir), model)
    return found.select("event_id", "consumption", "expected")


@_registered
def detect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model row per key, inner join."""
    model = load_model(spark, _model_files(spark, sf_dir))
    found = D.detect_by_lookup(tables.events(spark, sf_dir), model)
    return found.select("event_id", "consumption", "expected")


@_registered
def detect_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model stored by date, and only the readings' dates read back."""
    path = save_model(_model(spark, sf_dir), scratch_folder(spark, "model"))
    readings = M.with_hour_key(tables.events(spark, sf_dir))
    found = D.detect(readings, model_for(readings, spark.read.parquet(path)))
    return found.select("event_id", "consumption", _to_3(F.col("expected")).alias("expected"))


@_registered
def model_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, A2: a model of all days but the last two, to which these two are added one by one."""
    readings = tables.exact(tables.events(spark, sf_dir)).withColumn("day", F.to_date("ts"))
    store = ModelStore(scratch_folder(spark, "model-store"))
    last = readings.agg(F.max("day")).first()[0]
    age = F.greatest(F.date_diff(F.lit(last).cast("date"), F.col("day")), F.lit(0))
    for left in range(DAILY_ADDITIONS, -1, -1):
        part = age >= left if left == DAILY_ADDITIONS else age == left
        store.add(readings.where(part).drop("day"), _weather(spark, sf_dir), f"age-{left}")
    return _shown(store.model(spark))


def _rendered(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return D.detect_lines(_lines(spark, sf_dir), _published(spark, sf_dir), form)


@_registered
def render_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, R1."""
    return _rendered(spark, sf_dir, "bracket").select("value")


@_registered
def render_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, R2."""
    return _rendered(spark, sf_dir, "tuple").select("value")


@_registered
def render_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, R3."""
    return _rendered(spark, sf_dir, "message")


# ---- densification and replay ----------------------------------------------


@_registered
def densify_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type code 0."""
    return densify(tables.events(spark, sf_dir), NONE).select("event_id", "id", "consumption")


@_registered
def densify_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type code 1."""
    dense = densify(tables.events(spark, sf_dir), MULTIPLY, COPIES)
    return dense.select("event_id", "id", "consumption")


INTERPS = [Interp("ts", "date"), Interp("consumption", "double"), Interp("event_id", "long")]


def _dense_shown(dense: DataFrame) -> DataFrame:
    return dense.select(
        "id", epoch_millis(F.col("ts")).alias("ts_ms"), "event_id", "consumption", "event_type"
    )


@_registered
def densify_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D2a-D2e, W1, D3: type code 2, one chain per id."""
    readings = tables.events(spark, sf_dir)
    return _dense_shown(densify(readings, INTERPOLATE, STEPS, INTERPS, ["id"], ORDER, stored=True))


@_registered
def densify_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain over the whole table."""
    readings = tables.events(spark, sf_dir)
    return _dense_shown(densify(readings, INTERPOLATE, STEPS, INTERPS, [], ORDER, stored=True))


@_registered
def densify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 on text lines with position specs, parsed again for comparison."""
    specs = [f"1;Date;{TIMESTAMP_FORMAT}", "2;double", "0;colour"]
    dense = interpolate_lines(_lines(spark, sf_dir), STEPS, specs, ORDER, id_position=0, stored=True)
    return P.parse_readings(dense).select("id", "ts_text", "consumption")


@_registered
def densify_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains per id over segments far smaller than an id's rows."""
    readings = tables.events(spark, sf_dir)
    return _dense_shown(
        interpolate(readings, STEPS, INTERPS, ["id"], ORDER, rows_per_segment=SEGMENT_ROWS, stored=True)
    )


@_registered
def densify_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers between two records."""
    readings = tables.events(spark, sf_dir)
    dense = interpolate(readings, STEPS, [Interp("event_id", "integer")], ["id"], ORDER, stored=True)
    return dense.select("id", "event_id", "consumption")


LINE_SPECS = [f"1;Date;{TIMESTAMP_FORMAT}", "2;double"]


@_registered
def densify_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2f: lines that cannot be interpolated are left out, their neighbours become pairs."""
    lines = _cut_lines(spark, sf_dir)
    dense = interpolate_lines(lines, STEPS, LINE_SPECS, ORDER, id_position=0, mode="permissive", stored=True)
    return P.parse_readings(dense).select("id", "ts_text", "consumption")


@_registered
def densify_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2f, O3: the lines that were left out, with the reason."""
    return rejected_dense_lines(_cut_lines(spark, sf_dir), LINE_SPECS)


@_registered
def densify_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's kernel that holds the earlier value, then the later one."""

    def held(earlier: Column, later: Column, step: Column, n: int) -> Column:
        half = step * 2 < n
        return F.when(half, earlier["consumption"]).otherwise(later["consumption"])

    readings = tables.events(spark, sf_dir)
    dense = interpolate_with(readings, STEPS, {"consumption": held}, ["id"], ORDER, stored=True)
    return dense.select("id", "event_id", "consumption")


@_registered
def replay_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the second in which each record is due."""
    placed = send_slots(tables.events(spark, sf_dir), RECORDS_PER_SECOND, ORDER, stored=True)
    return placed.select("event_id", "slot")


@_registered
def replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: records keyed by send time; here the reading's own time."""
    return send_records(multiply(_lines(spark, sf_dir), 2), at=F.col("ts"))


@_registered
def marker_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timer record where a line equals the marker, here the last line."""
    lines = _lines(spark, sf_dir)
    marker = lines.agg(F.max_by("value", F.struct(*ORDER))).scalar()
    return marker_records(lines, marker, at=F.col("ts"))


@_registered
def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O2: totals of a densified run."""
    return run_totals(multiply(tables.events(spark, sf_dir), COPIES))


@_registered
def ingest_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O2: totals of a densified run, taken by the job that writes it."""
    out = file_target(scratch_folder(spark, "dense"))
    totals = write_with_totals(multiply(tables.events(spark, sf_dir), COPIES), out, F.col("ts"), F.col("ts"))
    written = spark.read.parquet(out.path).count()
    return totals.select("records", "shown", "duration", F.lit(written).alias("written"))


@_registered
def ingest_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O2: totals with the time between the first and the last record."""
    totals = timed_totals(tables.events(spark, sf_dir), F.col("ts"), F.col("ts"))
    return totals.select("records", "shown", "duration")


# ---- catalogue ---------------------------------------------------------------


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents")
    return documents.select(
        "source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value")
    )


@_registered
def dataset_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines per source, each source standing for a dataset."""
    shown = preview(_document_lines(spark, sf_dir), "source", ["doc_id", "line_no"])
    return shown.select("source", F.array_join("preview", "\n").alias("preview"))


@_registered
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a dataset for each source, listed and previewed."""
    folder = scratch_folder(spark, "datasets")
    # By ranges: a source with many lines takes several part files, whose names are in the order of its lines.
    place = ["source", "doc_id", "line_no"]
    lines = _document_lines(spark, sf_dir).repartitionByRange(*place).sortWithinPartitions(*place)
    lines.select("source", "value").write.partitionBy("source").text(folder)
    listed = catalog(spark, folder)
    return listed.withColumn("preview", F.array_join("preview", "\n"))


# ---- windows, joins and user jobs --------------------------------------------


def _window_aggregates() -> list[Column]:
    cents = F.round(F.col("consumption") * 100).cast("bigint")
    return [F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents")]


def _window_shown(df: DataFrame) -> DataFrame:
    return df.select("id", epoch_millis(F.col("window_start")).alias("start_ms"), "n", "cents")


@_registered
def tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1."""
    readings = tables.events(spark, sf_dir)
    return _window_shown(tumbling(readings, "1 day", ["id"], _window_aggregates()))


@_registered
def sliding_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2."""
    readings = tables.events(spark, sf_dir)
    cents = F.round(F.col("consumption") * 100).cast("bigint")
    return _window_shown(sliding_totals(readings, "6 hours", "1 hour", ["id"], {"cents": cents}))


@_registered
def late_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings more than an hour behind; each is delayed by its value in minutes."""
    minutes = F.make_dt_interval(mins=F.floor("consumption").cast("int"))
    measured = tables.events(spark, sf_dir).withColumn("ts", F.col("ts") - minutes)
    return late_rows(measured, ["event_id"], 3600, stored=True).select("event_id", "id")


@_registered
def join_within_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with their own anomaly records, which follow within the hour."""
    readings = tables.events(spark, sf_dir)
    alarms = _alarms(readings)
    joined = join_within(readings, alarms, ["event_id"], "ts", "alarm_ts", "1 HOUR")
    return joined.select("event_id", "id", epoch_millis(F.col("alarm_ts")).alias("alarm_ms"))


def _alarms(readings: DataFrame) -> DataFrame:
    """Alarms raised some minutes after a reading above the limit, one per cent of a unit each."""
    minutes = F.make_dt_interval(mins=F.floor("consumption").cast("int"))
    return D.above_limit(readings).select(
        "event_id", (F.col("ts") + minutes).alias("alarm_ts")
    )


@_registered
def join_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key in a third of the rows, compared with its neighbours in time only."""
    key = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("id") + 1)
    readings = tables.events(spark, sf_dir).withColumn("meter", key)
    alarms = D.above_limit(readings, HOT_LIMIT).select(
        "meter", F.col("event_id").alias("alarm_id"), F.col("ts").alias("alarm_ts")
    )
    joined = join_within(readings, alarms, ["meter"], "ts", "alarm_ts", "20 MINUTES")
    return joined.select("event_id", "alarm_id", "meter")


@_registered
def readings_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as a view, queried in SQL."""
    return spark.sql(
        "SELECT event_type, count(*) AS n, max(consumption) AS top "
        "FROM {readings} GROUP BY event_type",
        readings=tables.events(spark, sf_dir),
    )


@_registered
def user_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered jobs, chained."""
    register_job("twice", lambda df: multiply(df, 2))
    return _lines(spark, sf_dir).transform(job("threshold")).transform(job("twice")).select("value")


# ---- streams -------------------------------------------------------------------


def _feed(
    spark: SparkSession, sf_dir: str, form: str, *columns: str | Column, batches: int = FEED_BATCHES, by_id: bool = False
) -> str:
    """A folder in which the events arrive as files, in order of their time, a batch after the other.

    ``text`` holds lines of the given columns, ``parquet`` the events as they are.
    Events without a time arrive in the first batch.  ``by_id`` has them arrive
    in equal spans of their ids instead.
    """
    folder = scratch_folder(spark, "feed")
    events = tables.table(spark, sf_dir, "events")
    if by_id:
        batch = _arrival(events, batches)
    else:
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        shares = [k / batches for k in range(1, batches)]
        cuts = events.agg(F.percentile_approx(micros, shares)).first()[0] or []
        batch = sum((F.coalesce((micros > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    # The events are read once and dealt to a folder for each batch, whatever the number of batches.
    dealt, staged = events.withColumn(ARRIVAL, batch.cast("int")), scratch_folder(spark, "dealt")
    dealt.write.partitionBy(ARRIVAL).parquet(staged)
    held = spark.read.schema(dealt.schema).parquet(staged)
    for k in range(batches):
        part = held.where(F.col(ARRIVAL) == k).drop(ARRIVAL).repartition(FILES_PER_BATCH)
        if form == "parquet":
            part.write.mode("append").parquet(folder)
        else:
            readings = tables.as_readings(part).withColumn("ts", _ts_text(F.col("ts")))
            readings.select(F.concat_ws(",", *columns)).write.mode("append").text(folder)
    return folder


def _arrival(events: DataFrame, batches: int) -> Column:
    """The batch in which an event arrives if events arrive in equal spans of their ids."""
    last = events.agg(F.max("event_id")).first()[0] or 0
    return F.coalesce(F.call_function("div", F.col("event_id") * batches, F.lit(last + 1)), F.lit(0))


def _line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _feed(spark, sf_dir, "text", "id", "ts", "consumption")
    return stream_lines(spark, feed, FILES_PER_BATCH)


def _event_stream(spark: SparkSession, feed: str) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(feed).schema)
    return tables.as_readings(reader.option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(feed))


@_registered
def stream_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static threshold on a stream of lines."""
    out = scratch_folder(spark, "stream")
    found = D.lines_above_limit(_line_stream(spark, sf_dir))
    run_to_end(found, file_target(f"{out}/rows"), f"{out}/progress")
    return spark.read.schema("value string").parquet(f"{out}/rows")


@_registered
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O2: records of all batches, more of them than the query remembers."""
    out = scratch_folder(spark, "stream")
    lines = _line_stream(spark, sf_dir)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, 2)
    try:
        totals = run_measured(lines, file_target(f"{out}/rows"), f"{out}/progress")
    finally:
        spark.conf.set(kept, before)
    return totals.select("records", "shown")


@_registered
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model detection, one micro-batch at a time, against a stored model."""
    out = scratch_folder(spark, "stream")
    model = spark.read.parquet(save_model(_published(spark, sf_dir), f"{out}/model"))
    writer = detect_each_batch(model, file_target(f"{out}/rows"))
    run_to_end(_line_stream(spark, sf_dir), writer, f"{out}/progress")
    return spark.read.parquet(f"{out}/rows").select("value")


@_registered
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model detection as a plain stream-static join."""
    out = scratch_folder(spark, "stream")
    model = spark.read.parquet(save_model(_published(spark, sf_dir), f"{out}/model"))
    found = D.detect_lines(_line_stream(spark, sf_dir), model, "tuple").select("value")
    run_to_end(found, file_target(f"{out}/rows"), f"{out}/progress")
    return spark.read.schema("value string").parquet(f"{out}/rows")


@_registered
def stream_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2h: interpolation with the last record of each id carried between batches."""
    out = scratch_folder(spark, "stream")
    readings = _event_stream(spark, _feed(spark, sf_dir, "parquet"))
    writer = interpolate_each_batch(
        readings.schema, STEPS, INTERPS, ["id"], ORDER, file_target(f"{out}/rows"), f"{out}/state"
    )
    run_to_end(readings, writer, f"{out}/progress")
    return _dense_shown(spark.read.parquet(f"{out}/rows"))


@_registered
def stream_interpolate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2h: the same over so many batches that the log of last records merges its runs again and again."""
    out = scratch_folder(spark, "stream")
    readings = _event_stream(spark, _feed(spark, sf_dir, "parquet", batches=LOG_BATCHES))
    writer = interpolate_each_batch(
        readings.schema, STEPS, INTERPS, ["id"], ORDER, file_target(f"{out}/rows"), f"{out}/state"
    )
    run_to_end(readings, writer, f"{out}/progress")
    return _dense_shown(spark.read.parquet(f"{out}/rows"))


@_registered
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows behind the watermark go to a target of their own, with their batch; none is lost."""
    out = scratch_folder(spark, "stream")
    minutes = F.make_dt_interval(mins=F.floor("consumption").cast("int"))
    readings = _event_stream(spark, _feed(spark, sf_dir, "parquet", by_id=True))
    measured = readings.withColumn("ts", F.col("ts") - minutes)
    on_time, late = file_target(f"{out}/on_time"), file_target(f"{out}/late")
    run_to_end(measured, divert_late(on_time, late, LATE_SECONDS, f"{out}/state"), f"{out}/progress")
    schema = T.StructType([*measured.schema.fields, T.StructField("batch", T.IntegerType())])
    read = lambda target: spark.read.schema(schema).parquet(target.path)
    both = read(on_time).withColumn("late", F.lit(False)).unionByName(read(late).withColumn("late", F.lit(True)))
    return both.select("event_id", "batch", "late")


@_registered
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines and rejects of a stream, each with its own target, under one batch number."""
    out = scratch_folder(spark, "stream")
    good, bad = file_target(f"{out}/good"), file_target(f"{out}/bad")

    def split(lines: DataFrame, batch_id: int) -> None:
        tagged = P.tag_readings(lines)
        fine = tagged.where(F.col("reason").isNull()).select("value", "id")
        rest = tagged.where(F.col("reason").isNotNull()).select("value", "reason")
        write_split({"good": (fine, good), "bad": (rest, bad)}, batch_id, f"{out}/notes")

    feed = _feed(spark, sf_dir, "text", *_damaged_columns(F.col("ts")))
    run_to_end(stream_lines(spark, feed, FILES_PER_BATCH), split, f"{out}/progress")
    fine = spark.read.schema("value string, id bigint, batch int").parquet(good.path)
    rest = spark.read.schema("value string, reason string, batch int").parquet(bad.path)
    both = fine.withColumn("reason", F.lit(None).cast("string")).unionByName(rest, allowMissingColumns=True)
    # Only batches that were finished count.
    done = noted_batches(spark, f"{out}/notes").select("batch").distinct()
    return both.join(F.broadcast(done), "batch", "left_semi").select("value", "id", "reason")


@_registered
def stream_detect_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection stream that reports the lines it cannot read."""
    out = scratch_folder(spark, "stream")
    model = spark.read.parquet(save_model(_published(spark, sf_dir), f"{out}/model"))
    found, bad = file_target(f"{out}/rows"), file_target(f"{out}/rejects")
    feed = _feed(spark, sf_dir, "text", *_damaged_columns(F.col("ts")))
    writer = detect_each_batch(model, found, rejects=bad)
    run_to_end(stream_lines(spark, feed, FILES_PER_BATCH), writer, f"{out}/progress")
    anomalies = spark.read.schema("key string, value string").parquet(found.path)
    rejects = spark.read.schema("value string, reason string").parquet(bad.path).select("value", "reason")
    return anomalies.select("value", F.lit(None).cast("string").alias("reason")).unionByName(rejects)


@_registered
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset replayed at a steady rate, one batch each second."""
    out = scratch_folder(spark, "stream")
    readings = tables.events(spark, sf_dir)
    rate = max(1, -(-readings.count() // INTERVALS))
    store_slots(readings, rate, ORDER, f"{out}/slots", stored=True)
    replay(spark, f"{out}/slots", file_target(f"{out}/rows"), f"{out}/progress")
    sent = spark.read.schema("event_id bigint, slot bigint, batch int").parquet(f"{out}/rows")
    return sent.select("event_id", "slot", "batch")


@_registered
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of a stream; a day comes out once the watermark passes its end."""
    out = scratch_folder(spark, "stream")
    feed = _feed(spark, sf_dir, "parquet")
    readings = with_watermark(_event_stream(spark, feed), "2 hours")
    daily = _window_shown(tumbling(readings, "1 day", ["id"], _window_aggregates()))
    run_to_end(daily, file_target(f"{out}/rows"), f"{out}/progress", rows=spark.read.parquet(feed).count())
    return spark.read.schema("id bigint, start_ms bigint, n bigint, cents bigint").parquet(
        f"{out}/rows"
    )


@_registered
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined on key and time range."""
    out = scratch_folder(spark, "stream")
    feed = _feed(spark, sf_dir, "parquet")
    readings = with_watermark(_event_stream(spark, feed), "1 hour")
    alarms = with_watermark(_alarms(_event_stream(spark, feed)), "1 hour", "alarm_ts")
    joined = join_within(readings, alarms, ["event_id"], "ts", "alarm_ts", "1 HOUR").select(
        "event_id", "id", epoch_millis(F.col("alarm_ts")).alias("alarm_ms")
    )
    run_to_end(joined, file_target(f"{out}/rows"), f"{out}/progress", rows=spark.read.parquet(feed).count())
    return spark.read.schema("event_id bigint, id bigint, alarm_ms bigint").parquet(f"{out}/rows")


@_registered
def stream_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of CSV files, filtered in SQL."""
    out = scratch_folder(spark, "stream")
    feed = _feed(spark, sf_dir, "text", "id", "ts", "consumption", "event_type")
    schema = T.StructType([*CONSUMPTION_CSV.fields, T.StructField("event_type", T.StringType())])
    found = spark.sql(
        "SELECT event_type, id, consumption FROM {feed} WHERE consumption > 100",
        feed=stream_csv(spark, feed, schema, FILES_PER_BATCH),
    )
    run_to_end(found, file_target(f"{out}/rows"), f"{out}/progress")
    return spark.read.schema("event_type string, id bigint, consumption double").parquet(
        f"{out}/rows"
    )
