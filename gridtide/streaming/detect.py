"""Anomaly detection on a stream of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.operators.detect import detect, detect_lines, render_anomalies
from gridtide.operators.model import with_hour_key
from gridtide.operators.parse import parse_readings, tag_readings
from gridtide.sinks.split import write_split
from gridtide.sinks.targets import Target, write_batch


def detect_stream(lines: DataFrame, model: DataFrame, form: str = "bracket") -> DataFrame:
    """Streaming lines joined to a static model: the batch operator as it is.

    Spark reads the model again in every micro-batch, so this form is for
    models of moderate size; ``detect_each_batch`` reads only the dates it needs.
    """
    return detect_lines(lines, model, form)


def model_for(readings: DataFrame, model: DataFrame) -> DataFrame:
    """The part of the model that the readings' dates can match.

    On a model stored by date Spark prunes all other folders while the job
    runs: the readings' distinct dates are broadcast, and the scan of the model
    waits for them.  There is one for each day at most, so their size is bounded
    by the calendar.  The driver collects nothing.
    """
    # Spark prunes by a side only if something filters it; this filter keeps every date there is.
    earliest = F.lit("-200000-01-01").cast("date")
    dates = readings.where(F.col("date") >= earliest).select("date").distinct()
    return model.join(F.broadcast(dates), "date", "left_semi")


def detect_each_batch(
    model: DataFrame,
    target: Target,
    form: str = "bracket",
    mode: str = "permissive",
    rejects: Target | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch writer that matches each micro-batch with its own dates of the model.

    With ``rejects`` the lines that are no readings go there, with the reason,
    under the same batch (see ``sinks.split``); otherwise they are dropped.
    """
    if rejects is not None and mode == "strict":
        raise ValueError("strict parsing has no rejects")

    def process(lines: DataFrame, batch_id: int) -> None:
        # Read twice: once for its dates, once for the join; with rejects a third time.
        parsed = parse_readings(lines, mode=mode) if rejects is None else tag_readings(lines)
        parsed = with_hour_key(parsed).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            readings = parsed if rejects is None else parsed.where(F.col("reason").isNull())
            found = render_anomalies(detect(readings, model_for(readings, model)), form)
            if rejects is None:
                write_batch(found, target, batch_id)
            else:
                bad = parsed.where(F.col("reason").isNotNull()).select("value", "reason")
                write_split({"anomalies": (found, target), "rejects": (bad, rejects)}, batch_id)
        finally:
            parsed.unpersist()

    return process
